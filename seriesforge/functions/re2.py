"""Patterns of the query language (RE2 syntax) for the two engines that run them: Java's on executors, Python's for constants."""

from __future__ import annotations

import re

import regex

from ..model import QueryError

# The ASCII classes that RE2 knows by name.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t\x20", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": r"\x20-~",
    "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r\x20", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_PERL = {"s": r"\t\n\f\r\x20", "d": "0-9", "w": "0-9A-Za-z_"}
_GROUP = re.compile(r"\(\?(?:P?<([A-Za-z_]\w*)>|([imsU]*(?:-[imsU]+)?)([:)]))")


class Pattern:
    """java, python: the same pattern, anchored at both ends by full_match() and anchored; groups: numbers by name."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.groups: dict[str, int] = {}
        self.count = 0
        self.java, python = self._translated(), ""
        python = re.sub(r"\\z", r"\\Z", self.java)
        try:
            self._python = regex.compile(f"(?s:{python})")
        except regex.error as e:
            raise QueryError(f"invalid regular expression {text!r}: {e}") from e

    @property
    def anchored(self) -> str:
        return rf"\A(?s:{self.java})\z"

    def full_match(self, value: str) -> bool:
        return self._python.fullmatch(value) is not None

    def _refuse(self, what: str) -> None:
        raise QueryError(f"invalid regular expression {self.text!r}: {what}")

    def _translated(self) -> str:
        """Flags set inside a group hold to its end; quoted parts, named classes and ends are written out."""
        text, out, i = self.text, [], 0
        flags: list[list[str]] = [[]]  # of each open group: flags that were set inside it
        multiline = [False]  # does ^ mean lines
        while i < len(text):
            c = text[i]
            if c == "\\":
                i = self._escape(i, out)
                continue
            if c == "[":
                i = self._class(i, out)
                continue
            if c == "(":
                m = _GROUP.match(text, i)
                if text.startswith("(?", i) and not m:
                    self._refuse("unknown kind of group")
                if not m or m[1]:
                    self.count += 1
                if m and m[1]:
                    if m[1] in self.groups:
                        self._refuse("duplicate group name")
                    self.groups[m[1]] = self.count
                if not m or m[1]:
                    out.append("(")
                    flags.append([])
                    multiline.append(multiline[-1])
                    i = m.end() if m else i + 1
                    continue
                on, _, off = m[2].partition("-")
                if "U" in m[2]:
                    self._refuse("flag U is not supported")
                lines = (multiline[-1] or "m" in on) and "m" not in off
                out.append(f"(?{m[2]}:")
                if m[3] == ":":
                    flags.append([])
                    multiline.append(lines)
                else:  # to the end of the group around it
                    flags[-1].append(out[-1])
                    multiline[-1] = lines
                i = m.end()
                continue
            if c == ")":
                if len(flags) == 1:
                    self._refuse("unexpected )")
                out.append(")" * len(flags.pop()) + ")")
                multiline.pop()
            elif c == "|":  # flags hold for what follows, too
                out.append(")" * len(flags[-1]) + "|" + "".join(flags[-1]))
            elif c == "$":
                out.append("$" if multiline[-1] else r"\z")
            elif c == "+" and i and text[i - 1] in "*+?}" and not (i > 1 and text[i - 2] == "\\"):
                self._refuse("invalid nested repetition operator")
            else:
                out.append(c)
            i += 1
        if len(flags) > 1:
            self._refuse("missing )")
        return "".join(out) + ")" * len(flags[0])

    def _escape(self, i: int, out: list[str]) -> int:
        text = self.text
        if i + 1 >= len(text):
            self._refuse("trailing backslash")
        c = text[i + 1]
        if c == "Q":
            end = text.find(r"\E", i)
            quoted = text[i + 2 : end if end >= 0 else len(text)]
            out.append("".join("\\" + x if x in r"\.+*?()|[]{}^$-&#~ " else x for x in quoted))
            return end + 2 if end >= 0 else len(text)
        if c in "123456789CkGXRhHKNZ":
            self._refuse(f"invalid escape sequence \\{c}")
        known = _PERL.get(c.lower()) if c in "dswDSW" else None
        out.append(text[i : i + 2] if known is None else f"[^{known}]" if c.isupper() else f"[{known}]")
        return i + 2

    def _class(self, i: int, out: list[str]) -> int:
        """A class in brackets: a [ in it is a plain character."""
        text, j = self.text, i + 1
        part = ["["]
        if text[j : j + 1] == "^":
            part.append("^")
            j += 1
        first = True
        while j < len(text) and (text[j] != "]" or first):
            first = False
            if m := re.compile(r"\[:(\^?)(\w+):\]").match(text, j):
                if m[2] not in POSIX or m[1]:
                    self._refuse("invalid character class")
                part.append(POSIX[m[2]])
                j = m.end()
            elif text[j] == "\\" and j + 1 < len(text):
                part.append(_PERL.get(text[j + 1], text[j : j + 2]))
                j += 2
            else:
                part.append("\\" + text[j] if text[j] in "[]&~" else text[j])
                j += 1
        if j >= len(text):
            self._refuse("missing closing ]")
        out.append("".join(part) + "]")
        return j + 1
