"""A bounded subset of YAML: block and flow mappings and sequences, quoted and plain scalars, literal and folded
blocks, comments and several documents. Anchors, aliases, tags and merge keys are refused, so nothing that
is read means anything else than it says."""

from __future__ import annotations

import json
import re

_KEY = re.compile(r"""(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'|([^\s#&*!|>%@`\[\]{},"'?:-][^#]*?|[?:-](?=\S)[^#]*?))\s*:(?=\s|$)""")
_NUMBER = re.compile(r"[-+]?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?")


class YamlError(ValueError):
    """The text is outside the subset."""


def scalar(text: str):
    """A plain or quoted scalar's value."""
    if text.startswith('"') and text.endswith('"') and len(text) > 1:
        return json.loads(text)
    if text.startswith("'") and text.endswith("'") and len(text) > 1:
        return text[1:-1].replace("''", "'")
    if text[:1] in "&*!%@`|>":
        raise YamlError(f"not in the subset: {text[:20]}")
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if _NUMBER.fullmatch(text):
        return float(text) if re.search("[.eE]", text) else int(text)
    return text


def _uncommented(line: str) -> str:
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote and not (quote == '"' and line[i - 1] == "\\") else quote
        elif c in "\"'" and (i == 0 or line[i - 1] in " [{,:-"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i].rstrip()
    return line.rstrip()


class _Flow:
    """A flow collection on one logical line."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def _space(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def value(self):
        self._space()
        c = self.text[self.at : self.at + 1]
        if c in "[{" and c:
            self.at += 1
            return self._items(c)
        m = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,\[\]{}]*?)\s*(?=[,\]}]|:\s|:$|$)""").match(self.text, self.at)
        if not m:
            raise YamlError("flow value")
        self.at = m.end()
        return scalar(m[1])

    def _items(self, opened: str):
        out, close = ([], "]") if opened == "[" else ({}, "}")
        while True:
            self._space()
            if self.text[self.at : self.at + 1] == close:
                self.at += 1
                return out
            item = self.value()
            self._space()
            if opened == "{":
                if self.text[self.at : self.at + 1] != ":":
                    raise YamlError("flow mapping")
                self.at += 1
                out[str(item)] = self.value()
                self._space()
            else:
                out.append(item)
            if self.text[self.at : self.at + 1] == ",":
                self.at += 1
            elif self.text[self.at : self.at + 1] != close:
                raise YamlError("flow collection")


class _Block:
    def __init__(self, lines: list[tuple[int, str, str]]):
        self.lines, self.at = lines, 0

    def node(self, indent: int):
        """What stands at an indentation of `indent` or more from here on."""
        if self.at >= len(self.lines) or self.lines[self.at][0] < indent:
            return None
        here, text, _ = self.lines[self.at]
        if text == "-" or text.startswith("- "):
            return self._sequence(here)
        if _KEY.match(text):
            return self._mapping(here)
        self.at += 1
        return self._inline(text, here)

    def _inline(self, text: str, indent: int):
        if text[:1] in "[{":
            while text.count("[") + text.count("{") > text.count("]") + text.count("}") and self.at < len(self.lines):
                text += " " + self.lines[self.at][1]
                self.at += 1
            flow = _Flow(text)
            return flow.value()
        if text[:1] in "|>" and re.fullmatch(r"[|>][+-]?", text):
            return self._literal(text, indent)
        return scalar(text)

    def _literal(self, header: str, indent: int) -> str:
        rows = []
        while self.at < len(self.lines) and self.lines[self.at][0] > indent:
            rows.append(self.lines[self.at])
            self.at += 1
        least = min((r[0] for r in rows), default=0)
        joined = ("\n" if header[0] == "|" else " ").join(r[2][least:].rstrip() for r in rows)
        return joined if header.endswith("-") else f"{joined}\n"

    def _sequence(self, indent: int) -> list:
        out = []
        while self.at < len(self.lines) and self.lines[self.at][0] == indent and (self.lines[self.at][1] == "-" or self.lines[self.at][1].startswith("- ")):
            _, text, raw = self.lines[self.at]
            rest = text[1:].lstrip()
            if not rest:
                self.at += 1
                out.append(self.node(indent + 1))
                continue
            # What follows the dash is a node of its own, as far in as it stands.
            inner = indent + len(text) - len(rest)
            self.lines[self.at] = (inner, rest, raw)
            out.append(self.node(inner))
        return out

    def _mapping(self, indent: int) -> dict:
        out: dict = {}
        while self.at < len(self.lines) and self.lines[self.at][0] == indent:
            text = self.lines[self.at][1]
            m = _KEY.match(text)
            if not m:
                raise YamlError(f"not a key: {text[:20]}")
            key = json.loads(f'"{m[1]}"') if m[1] is not None else m[2].replace("''", "'") if m[2] is not None else m[3].strip()
            if key in out or key == "<<":
                raise YamlError(f"key {key}")
            rest = text[m.end() :].strip()
            self.at += 1
            if rest:
                out[key] = self._inline(rest, indent)
                continue
            # A sequence may stand as far in as its key.
            nxt = self.lines[self.at] if self.at < len(self.lines) else (-1, "", "")
            out[key] = self._sequence(indent) if nxt[0] == indent and (nxt[1] == "-" or nxt[1].startswith("- ")) else self.node(indent + 1)
        if self.at < len(self.lines) and self.lines[self.at][0] > indent:
            raise YamlError("indentation")
        return out


def documents(text: str) -> list:
    """The documents of a text."""
    out = []
    for part in re.split(r"(?m)^---(?:[ \t].*)?$", text):
        lines = []
        for raw in part.split("\n"):
            clean = _uncommented(raw.replace("\r", ""))
            if clean.strip() and clean.strip() != "..." and not clean.startswith("%"):
                if "\t" in clean[: len(clean) - len(clean.lstrip())]:
                    raise YamlError("tab")
                lines.append((len(clean) - len(clean.lstrip(" ")), clean.strip(), clean))
        if lines:
            block = _Block(lines)
            out.append(block.node(0))
            if block.at < len(block.lines):
                raise YamlError("what follows is no part of the document")
    return out


def load(text: str):
    """The one document of a text, JSON or of the subset."""
    if text.lstrip()[:1] in "{[":
        return json.loads(text)
    found = documents(text)
    if len(found) != 1:
        raise YamlError("documents")
    return found[0]
