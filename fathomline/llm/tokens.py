"""Exact and fast ids of whole texts under a public tokenizer file of the tokenizers library.

A word of one text is a word of another, so a worker remembers the ids of the chunks and words that it has
met; new words are merged by tiktoken with ranks taken from the same file. A vocabulary whose merges are
listed in the order of their ids gives the same ids either way; that order is verified when a file is loaded,
and the library still encodes every text that holds the string of an added token, which becomes that token's
id, or has letters beyond the Latin blocks or separators on which the two disagree about white space.

Null and empty texts have no ids. A text's ids are held whole, so memory is that of the longest text.
"""

from __future__ import annotations

import json
import re
import struct
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

from .common import per_worker

#: Characters that only the library itself encodes here: ASCII separators, the mark of a word's end, and all
#: beyond the Latin blocks; for a vocabulary with word ends also superscripts and fractions.
_LIBRARY = re.compile("[\x01\x1c-\x1fɐ-\U0010ffff]")
_SUPERSCRIPT = re.compile("[\xb2\xb3\xb9\xbc-\xbe]")
#: The word patterns of the two public vocabularies, the first as tiktoken takes it.
_BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WORD_ENDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[^\W_]|(?:[^\s\w]|_)+")
#: The mark that ends a word, in the place of the vocabulary's own.
_MARK = "\x01"
#: A byte-level text's chunks: what follows white space, with the one space before it, or other white space.
_SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Texts that are cut one by one (RE2): what the library encodes; for a byte-level vocabulary all whose white
#: space isn't single spaces and line ends between words.
_ODD_ENDS = r"[\x01\x1c-\x1f\x{85}\x{a0}\x{b2}\x{b3}\x{b9}\x{bc}-\x{be}\x{250}-\x{10FFFF}]"
_ODD_BYTES = r"\A[ \n]|[ \n]\z|[ \n][ \n]|[\x01\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{250}-\x{10FFFF}]"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters
    stand for themselves, the other bytes, in order, are written from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(path: str, model: dict, end: str) -> dict[bytes, int]:
    """Bytes of each token of a file's model, the end of a word written as _MARK."""
    byte_of = _byte_of()
    special = re.compile(r"<\|\w+\|>")
    out = {}
    for token, i in model["vocab"].items():
        if not special.fullmatch(token):
            closed = bool(end) and token.endswith(end)
            out[bytes(byte_of[c] for c in (token[: -len(end)] if closed else token)) + _MARK.encode() * closed] = i
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged) or not set(range(256)) < set(out.values()):
        raise ValueError(f"{path}: merges are not in the order of ids")
    return out


class Encoder:
    """Little-endian unsigned 32-bit ids of texts, for a byte-level vocabulary or, with word_ends, for one
    that drops white space and case and marks the ends of words. Of two generations of up to `limit` chunks
    in the memo the older is forgotten when the younger is full, so what is frequent stays. Of chunks that are
    new at once `limit` are remembered."""

    def __init__(self, path: str, word_ends: bool, limit: int = 100_000):
        self.path, self.word_ends, self.limit, self.library = path, word_ends, limit, None
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        ranks = _ranks(path, known["model"], "</w>" if word_ends else "")
        added = [re.escape(t["content"]) for t in known.get("added_tokens") or []]
        self.added = re.compile("|".join(added), re.I) if added else None
        pattern = f"[^{_MARK}\\n]+{_MARK}|\\n" if word_ends else _BYTE_LEVEL
        self.merges = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.line = ranks[b"\n"]
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks without line ends in them, all merged in one call: a line end, which is a token by
        itself, parts them."""
        text = "\n".join(chunks) + "\n"
        if self.word_ends:
            text = _WORD_ENDS.sub(rf"\g<0>{_MARK}", text.lower())
        ids = self.merges.encode_to_numpy(text).astype("<u4", copy=False)
        data, ends = ids.tobytes(), (np.flatnonzero(ids == self.line) * 4).tolist()
        return [data[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends, strict=False)]

    def runs(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk, from the memo or merged and remembered."""
        out = list(map(self.memo.get, chunks))
        new = [c for c, r in zip(chunks, out, strict=True) if r is None]
        if not new:
            return out
        new = list(dict.fromkeys(new))
        if len(self.memo) + len(new) > self.limit:
            self.old, self.memo = self.memo, {}
        found = {c: self.old[c] for c in new if c in self.old}
        rest = [c for c in new if c not in found]
        for c in [c for c in rest if not c or c.isspace()]:
            found[c] = np.array(self.merges._core_bpe.encode_single_piece(c.encode()) if c else [], "<u4").tobytes()
        rest = [c for c in rest if c not in found]
        if rest:
            found.update(zip(rest, self._learn(rest), strict=True))
        self.memo.update(islice(found.items(), self.limit))
        return [found[c] if r is None else r for c, r in zip(chunks, out, strict=True)]

    def by_library(self, text: str) -> bytes:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.added and self.added.search(text) or not (text.isascii() and text.isprintable()) and _LIBRARY.search(text):
            return self.by_library(text)
        if self.word_ends and not text.isascii() and _SUPERSCRIPT.search(text):
            return self.by_library(text)
        return b"".join(self.runs(text.split() if self.word_ends else _SPACED.findall(text)))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an array of texts, one after another, and where each text's begin (and the last's end).
        Ordinary texts are cut and gathered by Arrow, each distinct chunk of them being looked up once; the
        others are encoded one by one."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, _ODD_ENDS if self.word_ends else _ODD_BYTES)
        if self.added:
            odd = pc.or_(odd, pc.match_substring_regex(texts, self.added.pattern, ignore_case=True))
        odd = odd.to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd))
        lists = pc.utf8_split_whitespace(plain) if self.word_ends else pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        flat, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        code = flat.dictionary_encode()
        place = code.indices.to_numpy().astype(np.int64)
        words = code.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.word_ends:
            runs = self.runs(words)
        else:  # a line end stands for the space before a chunk, and a text's first chunk has neither
            first = bounds[:-1]
            heads, where = np.unique(place[first], return_inverse=True)
            line = struct.pack("<I", self.line)
            runs = self.runs([w[1:] if w[:1] == "\n" else f" {w}" for w in words] + [words[i] for i in heads.tolist()])
            runs = [line + r if w[:1] == "\n" else r for w, r in zip(words, runs, strict=False)] + runs[len(words) :]
            place[first] = len(words) + where
        sizes = np.fromiter(map(len, runs), np.int64, len(runs)) // 4
        table = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), pa.array(np.frombuffer(b"".join(runs), "<u4")))
        ids = table.take(pa.array(place)).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[place])])[bounds]
        if not odd.any():
            return ids, ends
        out, at = [], 0
        for text, alone in zip(texts.to_pylist(), odd.tolist(), strict=True):
            if alone:
                out.append(np.frombuffer(self.encode(text), "<u4"))
            else:
                out.append(ids[ends[at] : ends[at + 1]])
                at += 1
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])


def encoder(path: str, word_ends: bool, limit: int = 100_000) -> Encoder:
    """One per worker process, vocabulary and limit, until the process works for another operator."""
    return per_worker(f"encoder {path} {word_ends} {limit}", lambda: Encoder(path, word_ends, limit))
