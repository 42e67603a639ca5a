"""Regular-expression vocabulary of the call-document grammar.

A call document is a flat JSON object whose keys are exactly the declared
parameter keys of one function, each once, in any order.  The value grammar
depends only on the declared *type*, never on the function, so every pattern
here is a literal: it is compiled once per task by Spark (Java regex) and once
per query by DuckDB (RE2) in the oracle.  Keys are not spelled into the
patterns; they are captured and compared against the catalog with joins and
array functions.

Two dialects are produced from the same fragments:

* ``java``: possessive quantifiers (``*+``) so long string literals do not
  recurse on the JVM stack;
* ``re2``: the same expressions without possessive marks (RE2 is linear time
  and has no possessive syntax).

Anchors are ``\\A`` and ``\\z`` (Java ``$`` would also match before a final
newline).
"""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the accepted language (they must equal the reference's):
#   structural whitespace      space, newline, tab, carriage return
#   characters ending a number comma, closing brace, closing bracket,
#                              space, newline, tab  (no carriage return)
#   string escapes             \"  \\  \/  \b  \f  \n  \r  \t  \uXXXX
#   raw characters refused in strings: U+0000 .. U+001F
#   integer                    -?(0|[1-9][0-9]*)
#   number / float             integer with an optional .[0-9]+ part, no exponent
#   boolean                    true | false
#   null                       null
#   router fallback name       none
TYPE_NAMES = ("string", "number", "integer", "float", "boolean", "null")
ROUTER_FALLBACK = "none"

# Lexical classes a raw value can have; ``invalid`` when none applies.
LEXICAL_CLASSES = ("integer", "number", "string", "boolean", "null", "invalid")

# Declared type -> lexical classes it admits.
ADMITS = {
    "string": ("string",),
    "integer": ("integer",),
    "number": ("integer", "number"),
    "float": ("integer", "number"),
    "boolean": ("boolean",),
    "null": ("null",),
}

# Canonical type used for the grammar (``float`` is an alias of ``number``).
CANONICAL = {
    "string": "string",
    "integer": "integer",
    "number": "number",
    "float": "number",
    "boolean": "boolean",
    "null": "null",
}


@dataclass(frozen=True)
class Grammar:
    """All patterns of one regex dialect."""

    dialect: str

    # -- quantifier helpers -------------------------------------------------
    def _star(self) -> str:
        return "*+" if self.dialect == "java" else "*"

    def _opt(self) -> str:
        return "?+" if self.dialect == "java" else "?"

    # -- terminal fragments -------------------------------------------------
    @property
    def ws(self) -> str:
        return "[ \\t\\n\\r]" + self._star()

    @property
    def num_after(self) -> str:
        # A number may be followed by whitespace only if it starts with one
        # of its own terminators; CR may not come first.
        return "(?:[ \\t\\n][ \\t\\n\\r]" + self._star() + ")" + self._opt()

    @property
    def integer(self) -> str:
        return "-?(?:0|[1-9][0-9]*)"

    @property
    def number(self) -> str:
        return "-?(?:0|[1-9][0-9]*)(?:\\.[0-9]+)?"

    @property
    def string_body_char(self) -> str:
        return '[^"\\\\\\x00-\\x1f]'

    @property
    def escape(self) -> str:
        return '\\\\(?:["\\\\/bfnrt]|u[0-9A-Fa-f]{4})'

    @property
    def string(self) -> str:
        s = self._star()
        c = self.string_body_char
        return '"' + c + s + "(?:" + self.escape + c + s + ")" + s + '"'

    @property
    def open_string(self) -> str:
        """A string literal that has not ended; group 1 = its unfinished escape."""
        c, star = self.string_body_char, self._star()
        return '\\A"' + c + star + "(?:" + self.escape + c + star + ")" + star + "((?:\\\\(?:u[0-9A-Fa-f]{0,3})?)?)\\z"

    @property
    def closed_string(self) -> str:
        """A whole string literal; group 1 = what follows it."""
        return "(?s)\\A" + self.string + "(.*)\\z"

    @property
    def key_chars(self) -> str:
        return '[^"\\\\\\x00-\\x1f]*'

    # -- per-type value, its trailing whitespace and its proper prefixes ----
    def value(self, type_name: str) -> str:
        t = CANONICAL[type_name]
        return {
            "string": self.string,
            "integer": self.integer,
            "number": self.number,
            "boolean": "(?:true|false)",
            "null": "null",
        }[t]

    def after(self, type_name: str) -> str:
        t = CANONICAL[type_name]
        return self.num_after if t in ("integer", "number") else self.ws

    def prefix(self, type_name: str) -> str:
        """Every text that can still grow into a value of the type (incl. '')."""
        t = CANONICAL[type_name]
        if t == "integer":
            return "-?(?:0|[1-9][0-9]*)?"
        if t == "number":
            return "-?(?:(?:0|[1-9][0-9]*)(?:\\.[0-9]*)?)?"
        if t == "string":
            s = self._star()
            c = self.string_body_char
            open_body = '"' + c + s + "(?:" + self.escape + c + s + ")" + s
            partial_escape = "(?:\\\\(?:u[0-9A-Fa-f]{0,3})?)?"
            return "(?:" + open_body + partial_escape + ")?"
        if t == "boolean":
            return "(?:t(?:r(?:u)?)?|f(?:a(?:l(?:s)?)?)?)?"
        return "(?:n(?:u(?:l)?)?)?"

    def viable_value(self, type_name: str) -> str:
        """Rest after ``key:`` that is a live prefix (value not yet closed)."""
        return (
            "\\A(?:" + self.prefix(type_name) + "|"
            + self.value(type_name) + self.after(type_name) + ")\\z"
        )

    def closing_value(self, type_name: str) -> str:
        """Rest after ``key:`` that completes the value and the object."""
        return (
            "\\A" + self.value(type_name) + self.after(type_name)
            + "\\}" + self.ws + "\\z"
        )

    def lexical(self, cls: str) -> str:
        return "\\A(?:" + {
            "integer": self.integer,
            "number": self.number,
            "string": self.string,
            "boolean": "true|false",
            "null": "null",
        }[cls] + ")\\z"

    # -- document structure ---------------------------------------------------
    @property
    def any_value_after(self) -> str:
        """Any lexically valid value plus the whitespace its class allows."""
        return (
            "(?:" + self.string + self.ws
            + "|" + self.number + self.num_after
            + "|(?:true|false|null)" + self.ws + ")"
        )

    @property
    def item(self) -> str:
        """``"key" : value`` with group 1 = key, group 2 = value + trailing ws."""
        return (
            '"(' + self.key_chars + ')"' + self.ws + ":" + self.ws
            + "(" + self.any_value_after + ")"
        )

    @property
    def item_comma(self) -> str:
        return self.item + ","

    @property
    def unit(self) -> str:
        """One complete ``key: value , ws`` unit of the head (group 1 = key, 2 = value)."""
        return self.item_comma + self.ws

    @property
    def object_start(self) -> str:
        return "\\A" + self.ws + "\\{" + self.ws

    @property
    def leading_ws(self) -> str:
        return "\\A" + self.ws

    @property
    def head(self) -> str:
        """Longest prefix ``ws { ws (item , ws)*`` (group 0)."""
        unit = (
            '"' + self.key_chars + '"' + self.ws + ":" + self.ws
            + self.any_value_after + "," + self.ws
        )
        return "\\A" + self.ws + "\\{" + self.ws + "(?:" + unit + ")" + self._star()

    @property
    def document(self) -> str:
        """A complete object with at least one item (keys not yet checked)."""
        unit = (
            '"' + self.key_chars + '"' + self.ws + ":" + self.ws
            + self.any_value_after
        )
        return (
            "\\A" + self.ws + "\\{" + self.ws + unit
            + "(?:," + self.ws + unit + ")" + self._star()
            + "\\}" + self.ws + "\\z"
        )

    @property
    def empty_object(self) -> str:
        return "\\A" + self.ws + "\\{" + self.ws + "\\}" + self.ws + "\\z"

    @property
    def opened(self) -> str:
        return "\\A" + self.ws + "\\{"

    @property
    def blank(self) -> str:
        return "\\A" + self.ws + "\\z"

    @property
    def open_key(self) -> str:
        """Tail that is an unfinished quoted key; group 1 = the partial key."""
        return '\\A"(' + self.key_chars + ")\\z"

    @property
    def tail_item(self) -> str:
        """Tail ``"key" ws [: ws rest]``; groups: 1 key, 2 colon, 3 rest."""
        return (
            '(?s)\\A"(' + self.key_chars + ')"[ \\t\\n\\r]*'
            + "(?:(:)[ \\t\\n\\r]*(.*))?\\z"
        )

    @property
    def closed_object(self) -> str:
        """Prefix that is a syntactically closed object (keys unchecked)."""
        unit = (
            '"' + self.key_chars + '"' + self.ws + ":" + self.ws
            + self.any_value_after
        )
        return (
            "\\A" + self.ws + "\\{" + self.ws + "(?:" + unit
            + "(?:," + self.ws + unit + ")" + self._star() + ")" + self._opt()
            + "\\}" + self.ws
        )

    @property
    def loose_string(self) -> str:
        """A quoted text with any escapes and raw characters; no JSON string if they are refused there."""
        c, star = '[^"\\\\]', self._star()
        return '"' + c + star + "(?:\\\\[\\s\\S]" + c + star + ")" + star + '"'

    @property
    def leading_item(self) -> str:
        """A complete item at the start of a tail (groups as in ``item``)."""
        return "\\A" + self.item

    @property
    def router(self) -> str:
        """The router document: the single key ``name``; group 1 = raw value."""
        return (
            "\\A" + self.ws + "\\{" + self.ws + '"name"' + self.ws + ":" + self.ws
            + '("' + self.key_chars + '")' + self.ws + "\\}" + self.ws + "\\z"
        )

JAVA = Grammar("java")
RE2 = Grammar("re2")


def sql_literal(pattern: str) -> str:
    """Quote a pattern as a standard SQL string literal (no escape processing)."""
    return "'" + pattern.replace("'", "''") + "'"
