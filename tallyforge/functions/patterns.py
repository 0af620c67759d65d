"""Reads patterns of the dialect that browsers use (no ``u`` flag) and says them in Java's.

The two differ in what is valid and in what valid things mean: ``a++`` is an error there and possessive here, ``[^]``
matches anything there and is an error here, ``$`` is only the very end there, ``\\v`` one character there and a class
here. Letters are compared by Unicode case, but no character outside ASCII equals one inside.

Departures: text is matched by characters, not by UTF-16 units; a reference to a group that took no part in the match
fails; pattern modifiers are not valid; Java refuses to look behind over a length without a bound, which raises.
"""

from __future__ import annotations

from itertools import count

#: White space and line ends of the dialect.
SPACE = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
LINE_END = "\\n\\r\\u2028\\u2029"
#: Characters whose other case is an ASCII letter, and stand-ins that have no case.
FOREIGN, STAND_IN = "\u017F\u212A\u0130\u0131", "\uE000\uE001\uE002\uE003"

CONTROL = {"t": 9, "n": 10, "v": 11, "f": 12, "r": 13}
CLASSES = {"d": "[0-9]", "D": "[^0-9]", "w": "\\w", "W": "\\W", "s": f"[{SPACE}]", "S": f"[^{SPACE}]"}
WORD_EDGE = {"b": "(?:(?<=\\w)(?!\\w)|(?<!\\w)(?=\\w))", "B": "(?:(?<=\\w)(?=\\w)|(?<!\\w)(?!\\w))"}


class Invalid(ValueError):
    """The pattern is no pattern in this dialect."""


def literal(code: int) -> str:
    code = dict(zip(map(ord, FOREIGN), map(ord, STAND_IN), strict=True)).get(code, code)
    return f"\\x{{{code:X}}}"


class Reader:
    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0
        self.names = self._names()
        self.open: set[int] = set()
        self.closed: set[int] = set()
        self.groups = 0

    def _names(self) -> list[str | None]:
        """The name, or None, of each capturing group in the whole pattern."""
        out, i, inside = [], 0, False
        while i < len(self.text):
            c = self.text[i]
            if c == "\\":
                i += 1
            elif c == "[":
                inside = True
            elif c == "]":
                inside = False
            elif c == "(" and not inside:
                rest = self.text[i + 1 : i + 4]
                if not rest.startswith("?"):
                    out.append(None)
                elif rest.startswith("?<") and rest[2:3] not in ("=", "!"):
                    out.append(self.text[i + 3 : self.text.find(">", i)])
            i += 1
        return out

    def peek(self, *options: str) -> str | None:
        return next((o for o in options if self.text.startswith(o, self.at)), None)

    def take(self, *options: str) -> str | None:
        found = self.peek(*options)
        self.at += len(found) if found else 0
        return found

    def digits(self, most: int, base: str) -> str:
        end = self.at
        while end < min(len(self.text), self.at + most) and self.text[end] in base:
            end += 1
        found, self.at = self.text[self.at : end], end
        return found

    def whole(self) -> str:
        names = [n for n in self.names if n is not None]
        if len(set(names)) < len(names) or not all(n.isidentifier() or n.replace("$", "_").isidentifier() for n in names):
            raise Invalid("group names")
        out = self.choices()
        if self.at < len(self.text):
            raise Invalid("unmatched )")
        return out

    def choices(self) -> str:
        out = [self.sequence()]
        while self.take("|"):
            out.append(self.sequence())
        return "|".join(out)

    def sequence(self) -> str:
        out = []
        while self.at < len(self.text) and not self.peek("|", ")"):
            part, repeatable = self.term()
            out.append(part + self.repeat(repeatable))
        return "".join(out)

    def bounds(self) -> str | None:
        """``{n}``, ``{n,}`` or ``{n,m}``; None, and nothing taken, where a brace begins no such thing."""
        begin = self.at
        if self.take("{"):
            low = self.digits(len(self.text), "0123456789")
            comma = self.take(",")
            high = self.digits(len(self.text), "0123456789") if comma else ""
            if low and self.take("}"):
                if high and int(high) < int(low):
                    raise Invalid("numbers out of order")
                most = (1 << 31) - 1
                return f"{{{min(int(low), most)}" + (f",{min(int(high), most) if high else ''}" if comma else "") + "}"
        self.at = begin
        return None

    def repeat(self, allowed: bool) -> str:
        found = self.take("*", "+", "?") or self.bounds()
        if not found:
            return ""
        if not allowed:
            raise Invalid("nothing to repeat")
        return found + (self.take("?") or "")

    def term(self) -> tuple[str, bool]:
        if self.take("^"):
            return "^", False
        if self.take("$"):
            return "\\z", False
        if self.take("."):
            return f"[^{LINE_END}]", True
        if self.take("("):
            return self.group()
        if self.take("["):
            return self.bracket(), True
        if self.take("\\"):
            return self.escape()
        if self.peek("*", "+", "?"):
            raise Invalid("nothing to repeat")
        if self.peek("{") and self.bounds():
            raise Invalid("nothing to repeat")
        self.at += 1
        return literal(ord(self.text[self.at - 1])), True

    def group(self) -> tuple[str, bool]:
        number = None
        kind = self.take("?:", "?=", "?!", "?<=", "?<!")
        if not kind:
            if self.take("?<"):
                self.at = self.text.index(">", self.at) + 1 if ">" in self.text[self.at :] else self._fail("group name")
            elif self.peek("?"):
                raise Invalid("unknown group")
            self.groups += 1
            number = self.groups
            self.open.add(number)
        body = self.choices()
        if not self.take(")"):
            raise Invalid("unclosed group")
        if number:
            self.open.discard(number)
            self.closed.add(number)
        return f"({kind or ''}{body})", kind not in ("?<=", "?<!")

    def _fail(self, why: str) -> int:
        raise Invalid(why)

    def reference(self, number: int) -> str:
        """A group that is open or yet to come has matched nothing."""
        return f"(?:\\{number})" if number in self.closed else "(?:)"

    def escape(self) -> tuple[str, bool]:
        c = self.text[self.at : self.at + 1] or self._fail("\\ at the end")
        if c in WORD_EDGE:
            self.at += 1
            return WORD_EDGE[c], False
        if c in "123456789":
            end = next(i for i in count(self.at) if i == len(self.text) or self.text[i] not in "0123456789")
            if int(self.text[self.at : end]) <= len(self.names):
                number, self.at = int(self.text[self.at : end]), end
                return self.reference(number), True
        if c == "k" and any(self.names):
            self.at += 1
            end = self.text.find(">", self.at)
            name = self.text[self.at : end] if self.take("<") and end > 0 else None
            if name not in self.names:
                raise Invalid("unknown name")
            self.at = end + 1
            return self.reference(self.names.index(name) + 1), True
        code = self.character()
        return (code if isinstance(code, str) else literal(code)), True

    def character(self, inside: bool = False) -> int | str:
        """What an escape stands for: a character, or a class."""
        c = self.text[self.at : self.at + 1] or self._fail("\\ at the end")
        self.at += 1
        if c in CLASSES:
            return CLASSES[c]
        if c in CONTROL:
            return CONTROL[c]
        if c == "b" and inside:
            return 8
        if c in "01234567":
            self.at -= 1
            return int(self.digits(3 if c in "0123" else 2, "01234567"), 8)
        if c == "c":
            letter = self.text[self.at : self.at + 1]
            if letter.isascii() and (letter.isalpha() or inside and letter and (letter.isdigit() or letter == "_")):
                self.at += 1
                return ord(letter) % 32
            self.at -= 1  # the backslash stands for itself
            return ord("\\")
        if c in "xu":
            size = 2 if c == "x" else 4
            begin = self.at
            found = self.digits(size, "0123456789abcdefABCDEF")
            if len(found) == size:
                return int(found, 16)
            self.at = begin
        return ord(c)

    def bracket(self) -> str:
        negated, parts = bool(self.take("^")), []
        while not self.take("]"):
            low = self.member()
            if self.peek("-") and not self.peek("-]"):
                self.at += 1
                high = self.member()
                if isinstance(low, int) and isinstance(high, int):
                    if high < low:
                        raise Invalid("range out of order")
                    parts.append(f"{literal(low)}-{literal(high)}")
                    continue
                parts += [low, ord("-"), high]
            else:
                parts.append(low)
        if not parts:
            return "[\\x{0}-\\x{10FFFF}]" if negated else "(?!)"
        return "[" + "^" * negated + "".join(p if isinstance(p, str) else literal(p) for p in parts) + "]"

    def member(self) -> int | str:
        if self.at >= len(self.text):
            raise Invalid("unclosed class")
        if self.take("\\"):
            return self.character(inside=True)
        self.at += 1
        return ord(self.text[self.at - 1])


def java_pattern(pattern: str) -> str | None:
    """The pattern in Java's dialect, to be matched regardless of case against text whose ``FOREIGN`` characters are
    replaced by ``STAND_IN``; None if it is not valid."""
    try:
        return f"(?iu){Reader(pattern).whole()}"
    except Invalid:
        return None
