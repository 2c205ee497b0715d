"""Symbols, imports and tests of TypeScript source, by a scanner.

There is no TypeScript grammar here.  The scanner blanks comments, strings, templates and
regular expressions, keeps all offsets, and reads declarations by bracket depth.  It
covers the top level (exported or not), class members, and calls anywhere; decorators,
JSX text with quotes and overload lists are read only roughly.
"""

from __future__ import annotations

import re

#: Calls that make an endpoint or a test.
METHODS = ("get", "post", "put", "delete", "patch", "all")
ROUTERS = ("app", "router", "server", "api")
TESTS = ("test", "it")

_WORD = r"[A-Za-z_$][\w$]*"


def is_test(path: str) -> bool:
    return re.search(r"\.(test|spec)\.[cm]?[jt]sx?$", path) is not None


def blanked(source: str) -> str:
    """The source with blanks for what is no code; line ends and quotes stay."""
    out, i, n, last = list(source), 0, len(source), ""

    def blank(a, b):
        for j in range(a, min(b, n)):
            if out[j] != "\n":
                out[j] = " "

    while i < n:
        c = source[i]
        if source.startswith("//", i):
            j = source.find("\n", i)
            j = n if j < 0 else j
            blank(i, j)
            i = j
        elif source.startswith("/*", i):
            j = source.find("*/", i + 2)
            j = n if j < 0 else j + 2
            blank(i, j)
            i = j
        elif c in "'\"`":
            j = i + 1
            while j < n and source[j] != c and (c == "`" or source[j] != "\n"):
                j += 2 if source[j] == "\\" else 1
            blank(i + 1, j)
            i, last = j + 1, c
        elif c == "/" and (not last or last in "(,=:[!&|?{};+-*%~^<>\n"):
            j, group = i + 1, False
            while j < n and source[j] != "\n" and (group or source[j] != "/"):
                group = source[j] == "[" or (group and source[j] != "]")
                j += 2 if source[j] == "\\" else 1
            blank(i + 1, j)
            i, last = j + 1, "/"
        else:
            if not c.isspace():
                last = c
            i += 1
    return "".join(out)


class _Scan:
    def __init__(self, source: str):
        self.source, self.code = source, blanked(source)
        self.line_at = [0]
        for m in re.finditer("\n", source):
            self.line_at.append(m.end())
        self.pair: dict[int, int] = {}
        self.depth = [0] * (len(self.code) + 1)
        stack: list[int] = []
        for i, c in enumerate(self.code):
            if c in ")]}" and stack:
                self.pair[stack.pop()] = i
            self.depth[i] = len(stack)
            if c in "([{":
                stack.append(i)
        self.depth[len(self.code)] = len(stack)

    def line(self, at: int) -> int:
        import bisect

        return bisect.bisect_right(self.line_at, at)

    def close(self, at: int) -> int:
        return self.pair.get(at, len(self.code) - 1)

    def skip(self, at: int) -> int:
        while at < len(self.code) and self.code[at].isspace():
            at += 1
        return at

    def generics(self, at: int) -> int:
        """Past ``<...>`` if it stands here."""
        at = self.skip(at)
        if at < len(self.code) and self.code[at] == "<":
            d = 0
            while at < len(self.code):
                d += (self.code[at] == "<") - (self.code[at] == ">" and self.code[at - 1] != "=")
                at += 1
                if d == 0:
                    break
        return self.skip(at)

    def head(self, at: int) -> tuple[str | None, int]:
        """(signature, where the body or the arrow begins) of parameters at ``at``."""
        at = self.generics(at)
        if at >= len(self.code) or self.code[at] != "(":
            return None, at
        end = self.close(at) + 1
        text = re.sub(r"\s+", " ", self.source[at:end]).strip()
        i = self.skip(end)
        if i < len(self.code) and self.code[i] == ":":
            start, prev = i, ":"
            i += 1
            while i < len(self.code):
                c = self.code[i]
                if c in "([{" and not (c == "{" and prev not in ":|&<,=("):
                    i, prev = self.close(i) + 1, c
                    continue
                if c in "{;" or self.code.startswith("=>", i) or c == ")":
                    break
                if not c.isspace():
                    prev = c
                i += 1
            text += re.sub(r"\s+", " ", self.source[start:i]).strip()
        return text, i

    def statement_end(self, at: int, depth: int) -> int:
        """The last character of a statement: a semicolon, or a line end after which no
        operator goes on, at the given depth."""
        i = at
        while i < len(self.code):
            c = self.code[i]
            if c in "([{":
                i = self.close(i) + 1
                continue
            if self.depth[i] < depth:
                return i - 1
            if c == ";":
                return i
            if c == "\n":
                before, after = self.code[at:i].rstrip()[-1:], self.code[self.skip(i) : self.skip(i) + 1]
                if before not in "=,|&?:+-*<>(." and after not in list(".|&?:+-*=,<>") or not after:
                    return i - 1
            i += 1
        return len(self.code) - 1

    def string(self, at: int) -> str | None:
        """The text of a quoted string at ``at``."""
        at = self.skip(at)
        if at < len(self.code) and self.code[at] in "'\"":
            end = self.code.find(self.code[at], at + 1)
            return self.source[at + 1 : end] if end > 0 else None
        return None


_DECLARATION = re.compile(
    rf"(?:^|(?<=[;}}\n]))[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?:const\s+(?=enum\b))?"
    rf"\b(class|interface|enum|type|function|const|let|var)\b\s*\*?\s*({_WORD})?",
)
_MEMBER = re.compile(
    rf"(?:(?:public|private|protected|static|readonly|async|override|abstract|get|set|declare)\s+)*\*?\s*(#?{_WORD})\s*(\?|!)?\s*(?=[(<=:])"
)
_IMPORT = re.compile(r"(?:^|(?<=[;\n]))[ \t]*import\b")


def extract(path: str, source: str) -> dict[str, list[dict]]:
    s = _Scan(source)
    out: dict[str, list[dict]] = {"symbols": [], "imports": [], "tests": []}

    def add(name, kind, start, end, signature=None, parent=None):
        out["symbols"].append({"qualified_name": name, "kind": kind, "signature": signature, "start_line": s.line(start), "end_line": s.line(max(end, start)), "parent": parent})

    def function_value(at: int) -> str | None:
        """The signature if an arrow function or function expression stands at ``at``."""
        at = s.skip(at)
        m = re.compile(r"async\b\s*").match(s.code, at)
        at = m.end() if m else at
        m = re.compile(rf"function\b\s*\*?\s*(?:{_WORD})?").match(s.code, at)
        if m:
            return s.head(m.end())[0]
        sig, end = s.head(at)
        if sig is not None:
            return sig if s.code.startswith("=>", s.skip(end)) else None
        m = re.compile(rf"({_WORD})\s*=>").match(s.code, at)
        return m[1] if m else None

    def members(open_: int, owner: str) -> None:
        i, end, depth = open_ + 1, s.close(open_), s.depth[open_] + 1
        while i < end:
            i = s.skip(i)
            if i >= end:
                break
            if s.code[i] == "@":
                m = re.compile(rf"@[\w$.]+\s*").match(s.code, i)
                i = m.end()
                if i < end and s.code[i] == "(":
                    i = s.close(i) + 1
                continue
            m = _MEMBER.match(s.code, i)
            if not m:
                i = s.close(i) + 1 if s.code[i] in "([{" else i + 1
                continue
            at = m.end()
            if s.code[at] in "(<":
                sig, body = s.head(at)
                body = s.skip(body)
                if sig is not None and body < end and s.code[body] == "{":
                    last = s.close(body)
                    add(f"{owner}.{m[1]}", "method", i, last, sig, owner)
                    i = last + 1
                    continue
                i = s.statement_end(at, depth) + 1
                continue
            last = s.statement_end(at, depth)
            eq = at
            while eq <= last and not (s.code[eq] == "=" and s.code[eq + 1] not in "=>" and s.depth[eq] == depth):
                eq += 1
            sig = function_value(eq + 1) if eq <= last else None
            if sig is not None:
                add(f"{owner}.{m[1]}", "method", i, last, sig, owner)
            i = last + 1

    for m in _DECLARATION.finditer(s.code):
        kind, name = m[1], m[2]
        at = m.start(1)
        if s.depth[at] or not name:
            continue
        start = at
        prefix = re.compile(r"(?:abstract\s+|async\s+|const\s+)+$").search(s.code[m.start() : at])
        if prefix:
            start = m.start() + prefix.start()
        if kind in ("class", "interface", "enum"):
            open_ = m.end()
            while open_ < len(s.code) and s.code[open_] != "{":
                open_ = s.close(open_) + 1 if s.code[open_] in "([" else open_ + 1
            add(name, kind, start, s.close(open_) if open_ < len(s.code) else m.end())
            if kind == "class" and open_ < len(s.code):
                members(open_, name)
        elif kind == "type":
            add(name, "type", start, s.statement_end(m.end(), 0))
        elif kind == "function":
            sig, body = s.head(m.end())
            body = s.skip(body)
            if body < len(s.code) and s.code[body] == "{":
                add(name, "function", start, s.close(body), sig)
        else:
            last = s.statement_end(m.end(), 0)
            at = m.start(2)
            while at <= last:  # one declarator after the other
                d = re.compile(rf"({_WORD})").match(s.code, at)
                stop = at
                while stop <= last and s.code[stop] != ",":
                    stop = s.close(stop) + 1 if s.code[stop] in "([{" else stop + 1
                stop = min(stop, last + 1)
                if d:
                    eq = next((j for j in range(d.end(), stop) if s.code[j] == "=" and s.code[j + 1 : j + 2] not in ("=", ">") and s.depth[j] == 0), None)
                    sig = function_value(eq + 1) if eq is not None else None
                    if sig is not None:
                        end = last - (s.code[last] == ";") if stop > last else stop - 1
                        add(d[1], "function", at, end, sig)
                at = s.skip(stop + 1)

    for m in _IMPORT.finditer(s.code):
        if s.depth[m.start()] == 0 and s.code[s.skip(m.end())] != "(":
            end = s.statement_end(m.end(), 0)
            q = re.search(r"['\"]", s.code[m.end() : end + 1])
            spec = s.string(m.end() + q.start()) if q else None
            if spec:
                out["imports"].append({"specifier": spec, "start_line": s.line(s.skip(m.start()))})
    call = rf"(?<![\w$.])(?:(?P<o>{'|'.join(ROUTERS)})\s*\.\s*(?P<p>{'|'.join(METHODS)})|(?P<t>{'|'.join(TESTS)}))\s*(?=\()"
    for m in re.finditer(call, s.code):
        text = s.string(m.end() + 1)
        if text is None:
            continue
        if m["o"]:
            add(f"{m['p'].upper()} {text}", "endpoint", m.start(), s.close(m.end()))
        else:
            out["tests"].append({"name": text, "start_line": s.line(m.start())})
    for x in ("symbols", "tests", "imports"):
        out[x].sort(key=lambda r: r["start_line"])
    return out
