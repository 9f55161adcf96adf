"""Evaluation passages inside training text, whole or in part, found with one Aho-Corasick automaton.

Texts and passages are reduced to letters and digits in one case, without accents, mark-up, punctuation or spaces, so that
typography and line breaks don't matter. The automaton holds every run of ``SEED_WORDS`` consecutive words of every passage
(``SEED_CHARS`` characters in Chinese and Japanese). Every text is scanned once; offsets are mapped back to the original text only
for texts with hits. An item is in a text if

* ``RUN_WORDS`` consecutive words (``RUN_CHARS`` characters) of it stand there, checked literally on the reduced text, or
* hits and the words between them cover ``WHOLE`` of the passage: it is there as a whole, with single words changed, left out
  or added, or with its sentences apart or in another order.

The items are what is held out, not what grows with the corpus; their sizes are summed before any is fetched. Up to
``MAX_ITEM_CHARS`` characters they are sent to every task, which builds one automaton and scans its texts once. An automaton
takes some hundred bytes a character, so beyond that the items are dealt into groups of that size by a hash, and the texts are
scanned once a group; driver and tasks never hold more than one group.

Defined results: NULL and blank texts contain nothing; passages shorter than a run must be there as a whole; NULL passages are
left out; repeated rows give the same pair once; an item found in a text is reported once, with the stretch of the text from its
first to its last matched word.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN_WORDS, RUN_CHARS = 15, 25
SEED_WORDS, SEED_CHARS = 4, 8
#: Share of a passage's words that seeds must cover, a gap of up to GAP words between two aligned seeds included.
WHOLE, GAP = 0.7, 3
MAX_ITEM_CHARS = 2_000_000
DENSE = ("zh", "ja")
_MARKUP = re.compile(r"<[^<>\n]{1,200}>|&(?:nbsp|amp|lt|gt|quot|#\d+);|\]\([^()\s]*\)")


class _Reduced(dict):
    """Character -> its letters and digits in small case without accents; filled as characters are met."""

    def __missing__(self, code: int) -> str:
        parts = unicodedata.normalize("NFKD", chr(code)).casefold()
        out = "".join(c for c in unicodedata.normalize("NFKD", parts) if c.isalnum())
        self[code] = out
        return out


_REDUCED = _Reduced()


def reduced(text: str) -> str:
    """Letters and digits of a text, without mark-up."""
    return _MARKUP.sub("", text).translate(_REDUCED)


def offsets(text: str) -> list[int]:
    """For each character of ``reduced(text)`` the offset of the original character it came from."""
    out, at = [], 0
    for m in [*_MARKUP.finditer(text), None]:
        end = m.start() if m else len(text)
        for i in range(at, end):
            out += [i] * len(_REDUCED[ord(text[i])])
        at = m.end() if m else end
    return out


def words_of(passage: str, lang: str | None) -> list[str]:
    """Units that runs are counted in: reduced words, or reduced characters in Chinese and Japanese."""
    if lang in DENSE:
        return list(reduced(passage))
    return [w for w in map(reduced, _MARKUP.sub("", passage).split()) if w]


def automaton(items: tuple) -> tuple:
    """The automaton over the seeds of all items, and the words of every item."""
    seeds, words = defaultdict(list), {}
    for item, lang, passage in items:
        own = words_of(passage, lang)
        k = min(SEED_CHARS if lang in DENSE else SEED_WORDS, len(own))
        if not k:
            continue
        words[item] = (own, k, RUN_CHARS if lang in DENSE else RUN_WORDS)
        for i in range(len(own) - k + 1):
            seeds["".join(own[i : i + k])].append((item, i))
    search = ahocorasick.Automaton()
    for seed, places in seeds.items():
        search.add_word(seed, (len(seed), tuple(places)))
    if seeds:
        search.make_automaton()
    return search, words


def covered(places: list[tuple[int, int]], own: list[str], k: int) -> int:
    """Words of a passage that its hits cover; between two hits that stand in order and close by, up to GAP words more."""
    hit = [False] * len(own)
    for _, i in places:
        hit[i : i + k] = [True] * k
    by_place = sorted(set(places))
    for (end, i), (end2, j) in zip(by_place, by_place[1:], strict=False):
        if k < j - i <= k + GAP:
            gap = sum(map(len, own[i + k : j + k]))
            if abs((end2 - end) - gap) <= max(12, gap // 2):
                hit[i + k : j] = [True] * (j - i - k)
    return sum(hit)


def leaks(text: str, search: ahocorasick.Automaton, words: dict) -> list[tuple[int, int, int]]:
    """(item, start, end in the original text) of every item of an ``automaton`` that the text contains."""
    if not words:
        return []
    flat = reduced(text)
    hits = defaultdict(list)
    for end, (size, places) in search.iter(flat):
        for item, i in places:
            hits[item].append((end + 1, i, size))
    out, back = [], None
    for item, found in hits.items():
        own, k, run = words[item]
        places = [(end, i) for end, i, _ in found]
        starts = {i for _, i in places}
        need = run - k
        if len(own) < run:
            there = "".join(own) in flat
        else:
            there = any(all(i + d in starts for d in range(need + 1)) and "".join(own[i : i + run]) in flat for i in starts)
        if there or covered(places, own, k) >= WHOLE * len(own):
            back = back or offsets(text)
            first, last = min(end - size for end, _, size in found), max(end for end, _, _ in found)
            out.append((item, back[first], back[last - 1] + 1))
    return out


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end of every item found in every document."""
    rows = items.where("passage is not null").groupBy("item_id").agg(F.min(F.struct("lang", "passage")).alias("r")).select("item_id", "r.lang", "r.passage")
    groups = max(1, -(-(rows.agg(F.sum(F.length("passage"))).first()[0] or 0) // MAX_ITEM_CHARS))
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text").where("text is not null and trim(text) != ''")

    def one(group: int) -> DataFrame:
        sent = spark.sparkContext.broadcast(tuple(map(tuple, rows.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == group).orderBy("item_id").collect())))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            search, words = automaton(sent.value)
            for pdf in batches:
                out = [(doc, *leak) for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True) for leak in leaks(text, search, words)]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "start", "end"])

        return texts.mapInPandas(scan, "doc_id long, item_id long, start int, end int")

    found = one(0)
    for group in range(1, groups):
        found = found.unionByName(one(group))
    return found.dropDuplicates(["doc_id", "item_id"])
