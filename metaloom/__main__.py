from metaloom.cli import main

raise SystemExit(main())
