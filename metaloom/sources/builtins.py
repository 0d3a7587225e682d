"""The built-in contracts, from their rules."""

from __future__ import annotations

from typing import Any

DRAFT = "https://json-schema.org/draft/2020-12/schema"


def _contract(id_: str, title: str, properties: dict[str, Any], **more: Any) -> dict[str, Any]:
    return {"$schema": DRAFT, "$id": id_, "title": title, "type": "object", "additionalProperties": True, **more, "properties": properties}


def _each(names: str, rule: dict[str, Any]) -> dict[str, Any]:
    return {n: dict(rule) for n in names.split()}


STRING, NUMBER, BOOLEAN = {"type": "string"}, {"type": "number"}, {"type": "boolean"}
STRINGS = {"type": "array", "items": STRING}
REFERENCE = {"type": "string", "format": "uri-reference"}
NULLABLE = {"type": ["string", "null"]}
LEVEL = {"type": "number", "minimum": 2, "maximum": 6}
TAGS = {
    "type": "array",
    "items": {
        "type": ["string", "object"],
        "required": ["label", "permalink"],
        "additionalProperties": True,
        "properties": _each("description permalink label", STRING),
    },
}
LAST_UPDATE = {"type": "object", "minProperties": 1, "additionalProperties": False, "properties": _each("date author", STRING)}
#: A draft can't be unlisted as well.
VISIBILITY = {"if": {"required": ["draft"], "properties": {"draft": {"const": True}}}, "then": {"properties": {"unlisted": {"const": False}}}}

_AUTHOR = {
    "properties": _each("email key name title", STRING) | _each("imageURL url", REFERENCE) | {"socials": {"type": "object"}, "page": {"type": ["boolean", "object"]}}
}

BUILTINS: dict[str, dict[str, Any]] = {
    s["$id"]: s
    for s in (
        _contract(
            "google:okf:0.1",
            "Open Knowledge Format 0.1",
            {
                "type": {"type": "string", "minLength": 1},
                **_each("description title", STRING),
                "resource": {"type": "string", "format": "uri"},
                "tags": STRINGS,
                "timestamp": {"type": "string", "format": "date-time"},
            },
            required=["type"],
        ),
        _contract("diataxis:diataxis:1.0", "Diataxis page types 1.0", {"type": {"type": "string", "enum": "explanation how-to reference tutorial".split()}}, required=["type"]),
        _contract("passo-uno:seven-action:1.0", "Seven-Action model 1.0", {"action": {"type": "string", "enum": "appraise develop explore practice remember troubleshoot understand".split()}}),
        _contract(
            "tgdp:templates:1.0",
            "Good Docs template types 1.0",
            {
                "type": {
                    "type": "string",
                    "enum": sorted(
                        (
                            "tutorial how-to reference concept troubleshooting quickstart readme glossary changelog "
                            "release-notes style-guide terminology-system user-personas our-team contact-support bug-report "
                            "contributing-guide installation-guide sdk-overview api-reference api-getting-started"
                        ).split()
                        + ["code-of-conduct", *(f"code-of-conduct-{x}" for x in ("response-plan", "incident-record", "remediation-record"))],
                        key=lambda x: (len(x), x),
                    ),
                }
            },
            required=["type"],
        ),
        _contract(
            "docusaurus:docs:3.10",
            "Docusaurus docs front matter 3.10",
            {
                **_each("slug description title id sidebar_key sidebar_label sidebar_class_name pagination_label", STRING),
                **_each("hide_title draft unlisted parse_number_prefixes hide_table_of_contents", BOOLEAN),
                **_each("displayed_sidebar pagination_prev pagination_next", NULLABLE),
                **_each("toc_max_heading_level toc_min_heading_level", LEVEL),
                "sidebar_position": NUMBER,
                "sidebar_custom_props": {"type": "object"},
                "custom_edit_url": {"type": ["string", "null"], "format": "uri-reference"},
                "image": REFERENCE,
                "keywords": STRINGS,
                "tags": TAGS,
                "last_update": LAST_UPDATE,
            },
            **VISIBILITY,
        ),
        _contract(
            "docusaurus:blog:3.10",
            "Docusaurus blog front matter 3.10",
            {
                **_each("slug description title title_meta date sidebar_label author_title author", STRING),
                **_each("image author_image_url author_url", REFERENCE),
                **_each("hide_table_of_contents unlisted draft", BOOLEAN),
                **_each("toc_max_heading_level toc_min_heading_level", LEVEL),
                "keywords": STRINGS,
                "tags": TAGS,
                "last_update": LAST_UPDATE,
                "authors": {"type": ["string", "object", "array"], "$ref": "#/$defs/fields", "items": {"$ref": "#/$defs/author"}},
            },
            **VISIBILITY,
            **{"$defs": {"fields": _AUTHOR, "author": {"type": ["string", "object"], "$ref": "#/$defs/fields"}}},
        ),
        _contract(
            "docusaurus:pages:3.10",
            "Docusaurus pages front matter 3.10",
            {**_each("wrapperClassName slug description title", STRING), **_each("unlisted draft hide_table_of_contents", BOOLEAN), "image": REFERENCE, "keywords": STRINGS},
            **VISIBILITY,
        ),
    )
}

#: The set that a document without any other is checked against.
DEFAULT_SET = ("google:okf:0.1", "passo-uno:seven-action:1.0")
