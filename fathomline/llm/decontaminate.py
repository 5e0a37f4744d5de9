"""Benchmark decontamination: one Aho-Corasick automaton over the normalised questions and answers of a test set.

Text is normalised bytewise: A-Z becomes a-z, every other ASCII byte outside 0-9 and a-z becomes a
space, runs of spaces collapse. Bytes are then read as Latin-1 characters, so offsets in the automaton
are byte offsets, and each text is scanned once. A window is `width` consecutive words of an item; an
item with fewer words, but not none, is one window. Hits are mapped back to code points of the text.

The automaton holds each item once, cut into blocks of half a window, and not each of its windows, which
would take ten times the nodes: a window that occurs holds a whole block, and the words on either side of a
block that is found tell which windows do occur there.

Null or wordless text: no words, no hits. Null or wordless items: no windows. Repeated items keep their
own ids; repeated documents give repeated rows. A very long text is scanned whole, as one string; an empty
table of documents gives none back, an empty test set no hits. Extra columns of either table are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from itertools import islice

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, per_worker, trimmed

#: Words in a window.
WIDTH = 10
#: Characters of test-set text that one automaton may hold, a node of 40 bytes for each at most; more are dealt
#: over several passes, in pieces of so many words.
AUTOMATON_CHARS, PIECE = 4_000_000, 20_000

_FOLD = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")
_SPACES = re.compile(rb" +")
#: Text beyond which spaces are collapsed by a scan rather than through a list of the words.
_LONG = 1 << 20


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def flat_of(text: str | None) -> str:
    """The words of a text as Latin-1 characters, a space before, between and after them."""
    folded = text.encode("utf-8", "surrogatepass").translate(_FOLD) if text else b""
    joined = _SPACES.sub(b" ", folded).strip() if len(folded) > _LONG else b" ".join(folded.split())
    return f" {joined.decode('latin-1')} " if joined else ""


def build_automaton(items: list[tuple[int, str]], width: int = WIDTH):
    """The automaton of the blocks of all items. A block carries its number of words and, for each of the
    places that it has in items, the words before it (nearest first) and after it that a window may need, and
    the items; a whole item of less than a window carries nothing on either side."""
    half = max(1, width // 2)
    keys: dict[tuple, dict[tuple, set]] = {}
    for item_id, text in items:
        words = words_of(text)
        if 0 < len(words) < width:
            keys.setdefault(tuple(words), {}).setdefault(None, set()).add(item_id)
        for p in range(0, len(words) - half + 1, half) if len(words) >= width else ():
            sides = tuple(words[max(0, p - half + 1) : p][::-1]), tuple(words[p + half : p + width])
            keys.setdefault(tuple(words[p : p + half]), {}).setdefault(sides, set()).add(item_id)
    if not keys:
        return None
    automaton = ahocorasick.Automaton()
    text_of = lambda sides: sides and tuple(tuple(w.decode("latin-1") for w in side) for side in sides)
    for key, places in keys.items():
        automaton.add_word(f" {b' '.join(key).decode('latin-1')} ", (len(key), [(text_of(s), frozenset(ids)) for s, ids in places.items()]))
    automaton.make_automaton()
    return automaton


def _before(flat: str, end: int, most: int) -> list[str]:
    """Up to `most` words before a space at `end`, nearest first."""
    out = []
    while len(out) < most and end > 0:
        start = flat.rfind(" ", 0, end)
        out.append(flat[start + 1 : end])
        end = start
    return out


def _after(flat: str, start: int, most: int) -> list[str]:
    """Up to `most` words after a space at `start`."""
    out = []
    while len(out) < most and start + 1 < len(flat):
        end = flat.find(" ", start + 1)
        out.append(flat[start + 1 : end])
        start = end
    return out


def _common(a, b) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def scan(text: str | None, automaton, width: int = WIDTH) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, the disjoint [from, to) word intervals that windows cover, and the items found."""
    flat = flat_of(text)
    spans: list[tuple[int, int]] = []
    found: set = set()
    if flat and automaton is not None:
        half = max(1, width // 2)
        at = done = 0
        for end, (n, places) in automaton.iter(flat):
            at += flat.count(" ", done, end)
            done = end
            sides = None
            for needed, ids in places:
                if needed is None:
                    spans.append((at - n, at))
                    found |= ids
                    continue
                if sides is None:
                    start = end
                    for _ in range(n):
                        start = flat.rfind(" ", 0, start)
                    sides = _before(flat, start, half - 1), _after(flat, end, width - half)
                left, right = _common(needed[0], sides[0]), _common(needed[1], sides[1])
                if left + n + right >= width:
                    spans.append((at - n - left, at + right))
                    found |= ids
    return max(0, flat.count(" ") - 1), merged(spans), found


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets in the untouched text of word intervals, which are disjoint and in order."""
    raw = text.encode("utf-8", "surrogatepass")
    words, seen = _WORD.finditer(raw.translate(_FOLD)), 0
    chars = lambda a, b: len(raw[a:b].decode("utf-8", "surrogatepass"))
    out, byte, char = [], 0, 0
    for a, b in spans:
        first = next(islice(words, a - seen, None))
        last = next(islice(words, b - a - 2, None)) if b - a > 1 else first
        seen = b
        start = char + chars(byte, first.start())
        char = start + chars(first.start(), last.end())
        byte = last.end()
        out.append((start, char))
    return out


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_SPANS = "array<struct<start:long,end:long>>"
_FOUND = (("n_words", "long"), ("word_spans", _SPANS), ("item_ids", "array<long>"), ("char_spans", _SPANS))


def find_contamination(docs: DataFrame, items: DataFrame, keep: tuple = ("doc_id",), width: int = WIDTH, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """For each row of docs its columns `keep` as struct `row`, text, the number of words, the word
    intervals that windows cover, the ids of the items, and the intervals in code points of the text.

    The test set is broadcast only up to `automaton_chars` characters; a larger one is dealt over several
    automata, one pass each, whose hits are united row by row, so the result does not depend on the bound.
    """
    words = F.regexp_extract_all(F.translate(F.col("text").cast("string"), _UPPER, _UPPER.lower()), F.lit(_ITEM_WORD), F.lit(0))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), words.alias("words")).where("item_id is not null and size(words) > 0")
    # Pieces of long items overlap by a window less a word, so each window lies in one piece whole.
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)), F.lit(PIECE))
    items = items.withColumn("at", F.explode(starts)).select("item_id", "at", F.array_join(F.slice("words", F.col("at") + 1, PIECE + width - 1), " ").alias("text"))
    items = materialise(items, "decontaminate-items")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // automaton_chars))
    out = docs.select(F.struct(*keep).alias("row"), F.col("text").cast("string").alias("text"))
    out = out.withColumns({c: (F.lit(None) if t == "long" else F.array()).cast(t) for c, t in _FOUND})
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64("item_id", "at", "text"), F.lit(parts)) == k) if parts > 1 else items
        shipped = docs.sparkSession.sparkContext.broadcast(sorted((r.item_id, r.text) for r in part.collect()))
        token = uuid.uuid4().hex

        def scanned(batches, shipped=shipped, token=token):
            automaton = per_worker(token, lambda: build_automaton(shipped.value, width))
            for batch in batches:
                n, words, ids, chars = [], [], [], []
                for text, old_spans, old_ids in zip(batch.column(1), batch.column(3), batch.column(4), strict=True):
                    text = text.as_py()
                    n_words, spans, found = scan(text, automaton, width)
                    if len(old_spans):
                        spans = merged([*spans, *((x["start"], x["end"]) for x in old_spans.as_py())])
                        found = found | set(old_ids.as_py())
                    n.append(n_words)
                    ids.append(sorted(found))
                    words.append([{"start": a, "end": b} for a, b in spans])
                    chars.append([{"start": a, "end": b} for a, b in original_offsets(text, spans)] if spans else [])
                made = (pa.array(n, pa.int64()), pa.array(words, pa.list_(_SPAN)), pa.array(ids, pa.list_(pa.int64())), pa.array(chars, pa.list_(_SPAN)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["row", "text", *(c for c, _ in _FOUND)])

        out = out.mapInArrow(trimmed(scanned), schema)
        if k + 1 < parts:
            out = materialise(out, "decontaminate")
    return out


def digest(found: DataFrame) -> DataFrame:
    """The columns that op9 is compared by."""
    ids = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    hit = F.aggregate("word_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "row.doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.concat_ws(",", F.transform("char_spans", lambda s: F.concat_ws(":", s["start"], s["end"]))).alias("hit_offsets"),
    )


def sha_of(ids) -> str:
    """items_sha256 of a collection of ids, as digest() gives it."""
    return hashlib.sha256(",".join(sorted(map(str, set(ids)))).encode()).hexdigest()


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs, with its own columns, without the rows in which any window of the test set occurs."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    clean = find_contamination(docs, items, keep, width).where(F.size("item_ids") == 0)
    return clean.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The columns of the contract; hit_offsets, which SQL cannot give, is compared by tests.
ORACLE_SQL = f"""
WITH items AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
keys AS (
    SELECT DISTINCT item_id, least(len(w), {WIDTH}) AS n, array_to_string(w[i : i + least(len(w), {WIDTH}) - 1], ' ') AS k
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
places AS (
    SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM keys) WHERE len(w) >= n)
), hits AS (SELECT doc_id, item_id, i, p.n FROM places p JOIN keys USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hits GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""
