"""Element names by namespace and named entities: the pass over feed documents whose plain text does not show what they mean.

One pass over the tokens of a document (tags, CDATA, comments, instructions, the document type, text between) with a stack of the prefixes
in force. An element of a known namespace gets the name that the schema reads, whatever prefix it is written with and wherever that prefix is
bound; a prefix bound to an unknown address is kept. Entities of HTML and of the document's own type declaration become characters; CDATA,
comments and what cannot be understood stay as they are. Only documents that ``needs_pass`` finds are sent through it.
"""

from __future__ import annotations

import re
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Addresses of the namespaces that are read, by the prefix that the schema uses. Plain RSS elements have none.
NAMESPACES = {
    "itunes": ("http://www.itunes.com/dtds/podcast-1.0.dtd", "http://example.com/dtds/podcast-1.0.dtd"),
    "atom": ("http://www.w3.org/2005/Atom", "http://purl.org/atom/ns#"),
    "dc": ("http://purl.org/dc/elements/1.1/",),
    "content": ("http://purl.org/rss/1.0/modules/content/",),
    "rdf": ("http://www.w3.org/1999/02/22-rdf-syntax-ns#",),
    "": ("http://purl.org/rss/1.0/", "http://my.netscape.com/rdf/simple/0.9/", "http://channel.netscape.com/rdf/simple/0.9/"),
}
_PREFIXES = {address.lower(): prefix for prefix, addresses in NAMESPACES.items() for address in addresses}
_KNOWN_ENTITIES = {"amp", "lt", "gt", "quot", "apos"}
#: Longest text that an entity of the document's own may stand for: longer ones are not filled in, so that a document cannot blow itself up.
LONGEST_ENTITY = 1000

_QUOTED = r"\"[^\"]*\"|'[^']*'"
_TOKEN = re.compile(
    rf"<!\[CDATA\[.*?\]\]>|<!--.*?-->|<\?.*?\?>|<!DOCTYPE(?:[^\[>\"']|{_QUOTED})*+(?:\[.*?\]\s*)?>|</?[A-Za-z_](?:[^<>\"']|{_QUOTED})*+>", re.S)
_NAME = re.compile(r"</?([^\s/>]+)")
_BINDING = re.compile(r"\sxmlns(?::([^\s=]+))?\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_ENTITY = re.compile(r"&([A-Za-z_][\w.-]*);")
_DECLARED = re.compile(r"<!ENTITY\s+([A-Za-z_][\w.-]*)\s+(?:\"([^\"]*)\"|'([^']*)')\s*>")
_NUMBERED = re.compile(r"&#(?:x([0-9A-Fa-f]{1,6})|([0-9]{1,7}));")


def _character(m: re.Match) -> str:
    code = int(m[1], 16) if m[1] else int(m[2])
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]


def _declared(document_type: str) -> dict[str, str]:
    """The entities of a document type that stand for plain text."""
    found = {}
    for m in _DECLARED.finditer(document_type):
        value = _NUMBERED.sub(_character, m[2] if m[2] is not None else m[3])
        if len(value) <= LONGEST_ENTITY and "&" not in value and "<" not in value:
            found.setdefault(m[1], value)
    return found


class _Names:
    """The open elements of a document: as written, as renamed, and the prefixes in force in each."""

    def __init__(self):
        self.open: list[tuple[str, str, dict[str | None, str]]] = []
        self.in_atom: bool | None = None

    def start(self, tag: str) -> str:
        written = _NAME.match(tag)[1]
        scope = self.open[-1][2] if self.open else {}
        bound = {m[1]: m[2] if m[2] is not None else m[3] for m in _BINDING.finditer(tag)}
        scope = scope | bound if bound else scope
        prefix, _, local = written.rpartition(":")
        known = _PREFIXES.get(scope.get(prefix or None, "").strip().lower())
        if self.in_atom is None:
            self.in_atom = known == "atom"
        renamed = written
        if known == "atom":
            plain = self.in_atom or (not prefix and local != "link")
            renamed = local if plain else f"atom:{local}"
        elif known is not None:
            renamed = f"{known}:{local}" if known else local
        if not tag.endswith("/>"):
            self.open.append((written, renamed, scope))
        return tag if renamed == written else f"<{renamed}{tag[1 + len(written):]}"

    def end(self, tag: str) -> str:
        """The end tag of the innermost open element of that name, which also closes what was left open in it."""
        written = _NAME.match(tag)[1]
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == written:
                renamed = self.open[i][1]
                del self.open[i:]
                return tag if renamed == written else f"</{renamed}>"
        return tag


def resolved(text: str) -> str:
    """The document with its elements under the names of the schema and its named entities as characters."""
    names, entities, out, at = _Names(), {}, [], 0

    def entity(m: re.Match) -> str:
        value = entities.get(m[1])
        if value is None and m[1] not in _KNOWN_ENTITIES and m[1] in name2codepoint:
            value = chr(name2codepoint[m[1]])
        if value is None:
            return m[0]
        for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
            value = value.replace(raw, escaped)
        return value

    for m in _TOKEN.finditer(text):
        out.append(_ENTITY.sub(entity, text[at : m.start()]))
        at, token = m.end(), m[0]
        if token.startswith("<!DOCTYPE"):
            entities |= _declared(token)
        elif token[1] in "!?":
            out.append(token)
        else:
            out.append(names.end(token) if token[1] == "/" else _ENTITY.sub(entity, names.start(token)))
    out.append(_ENTITY.sub(entity, text[at:]))
    return "".join(out)


def _any_of(prefix: str) -> str:
    return "(?:" + "|".join(re.escape(a) for a in NAMESPACES[prefix]) + ")"


def needs_pass(xml: Column) -> Column:
    """Whether a document binds a known address to another prefix than the schema's, or uses an entity that XML does not know.

    The patterns follow on one of the three characters that they begin with, so that most characters of a document cost one look.
    """
    patterns = [r"(?<=&)(?!(?:amp|lt|gt|quot|apos);)[a-z_][a-z0-9_.-]*;", r"(?<=<)(?!rdf:)[a-z_][^\s<>:/]*:(?:feed|rdf|rss)[\s>]"]
    for prefix in NAMESPACES:
        usual = rf"(?!{prefix}\s*=)" if prefix else ""
        patterns.append(rf"""(?<=\sx)mlns:{usual}[^\s=]+\s*=\s*["']{_any_of(prefix)}["']""")
        if prefix not in ("", "atom"):
            patterns.append(rf"""(?<=\sx)mlns\s*=\s*["']{_any_of(prefix)}["']""")
    patterns.append(rf"""(?<=<)(?!(?:feed|rss)[\s>])[a-z_][^<>]*\sxmlns\s*=\s*["']{_any_of("atom")}["']""")
    return F.rlike(xml, F.lit("(?i)[&<x](?:" + "|".join(patterns) + ")"))


@F.arrow_udf(StringType())
def _resolved(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else resolved(t) for t in texts.to_pylist()], pa.string())


def with_usual_names(xml: Column) -> Column:
    """Documents that need it through the pass, the others as they are, without leaving the JVM."""
    return F.coalesce(_resolved(F.when(needs_pass(xml), xml)), xml)
