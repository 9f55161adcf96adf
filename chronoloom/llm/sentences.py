"""Sentence units of texts in any of the project's languages and scripts, by document-centred disambiguation.

A period is ambiguous; whether it ends a sentence follows from the word before it (an abbreviation or not) and the word after it
(one whose capital means a new sentence, or a name). Both are decided from unambiguous occurrences: first elsewhere in the same document,
and where the document says nothing, from counts over the whole corpus. Abbreviations show themselves by a period before
a lower-case word or a comma, or by never standing without their period; words that are no names by
also occurring in lower case. Scripts with terminators of their own (CJK, Devanagari, Arabic)
follow their rules, Thai is divided at spaces between Thai letters.

Texts are read for evidence once: what they say of the words they ask about, and their share of the corpus counts, pre-aggregated per
batch, go to the shared checkpoint folder. Every document is then joined with the counts of just the words it asks about.
Words that many documents ask about are joined apart: at most ``FREQUENT`` words can each have 1 / ``FREQUENT`` of all questions, so
their counts are sent to every task, and no other word makes a hot key.

Defined results: NULL, empty and blank texts have no units; offsets count Unicode characters of the text as it is; documents with
equal doc_id are segmented each; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.session import cut

TERMINATORS = ".!?…‽。！？｡．।॥؟۔"
FULL = "。！？｡।॥؟۔"
OPENERS = {"(": ")", "（": "）", "[": "]", "【": "】", "“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "‘": "’", "‹": "›"}
QUOTES = "“„«「『‘‹"
CLOSERS = "\\)）\\]】”»」』’›\"'"
CLOSING = " \n\t" + ")）]】”»」』’›\"'"
_BREAK = regex.compile(r"\n[^\S\n]*(?:\n\s*)+|\n(?=[^\S\n]*(?:[-*•]|\d+\.)[^\S\n])")
_LIST = regex.compile(r"[^\S\n]*(?:[-*•]|\d+\.)[^\S\n]")
_STOP = regex.compile(rf"(?:[{TERMINATORS}]+|(?<=[\p{{Thai}}])\s+(?=[\p{{Thai}}]))")
_AFTER = regex.compile(rf"(?:[{CLOSERS}]|[^\S\n](?=»))*")
_NEXT = regex.compile(r"\s*(?:[“„«「『‘‹(\[\"'¿¡][^\S\n]?)*([\p{L}\p{M}\d]+)")
_TOKEN_BACK = regex.compile(r"(?r)[\p{L}\p{M}]+(?:[.’'-][\p{L}\p{M}]+)*")
_SOLID = regex.compile(r"\S")
_WORD = r"[\p{L}\p{M}]+(?:[.’'-][\p{L}\p{M}]+)*"
_WORDS = regex.compile(_WORD)
_NUMBER = regex.compile(r"(?<![\w.,:-])\d{1,2}\Z")
_PAIRS = regex.compile("[" + regex.escape("".join(OPENERS) + "".join(OPENERS.values())) + '"]')
#: A word that stands with a period at least so often, and at most this share of times without it, is an abbreviation.
SEEN, PLAIN_SHARE, SHORT = 3, 0.02, 5
#: A word is followed by numbers that belong to it if this share of its undecided occurrences are before a number.
NUMBER_SHARE = 0.5
#: Words whose counts are sent to every task: those that make up at least 1 / FREQUENT of all questions.
FREQUENT = 2_000
#: Occurrences in lower case, and their share against capitalised ones inside sentences, that make a capital mean a new sentence.
OPENS, OPEN_SHARE = 2, 0.5


def paragraphs(text: str) -> Iterator[tuple[int, int, bool]]:
    """Start, end and whether it is a list line, of the stretches that blank lines and list marks delimit."""
    at = 0
    for m in [*_BREAK.finditer(text), None]:
        end = m.start() if m else len(text)
        if text[at:end].strip():
            yield at, end, bool(_LIST.match(text, at, end))
        at = m.end() if m else end


#: What is counted of a word: with period; so inside a sentence (a small letter or comma follows), before a number, at the end of a
#: paragraph; without period; opening a sentence; capitalised inside a sentence; in lower case.
KINDS = ("dotted", "inside", "numbered", "final", "plain", "opening", "capital", "lower")


_DOTTED = regex.compile(r"(?<![\p{L}\p{M}])([\p{L}\p{M}]++(?:[.’'-][\p{L}\p{M}]++)*+)\.(?=(.{0,3}))", regex.DOTALL)
_OPENING = regex.compile(r"[!?…]\s+[“„«「『‘‹(\[\"'¿¡\s]*(\p{Lu}[\p{L}\p{M}]*)")
_CAPITAL = regex.compile(r"(?<=[\p{L}\p{M}\p{N},;]\s)(\p{Lu}[\p{L}\p{M}]*)")
_FIRST = regex.compile(r"\W*(\p{Lu}[\p{L}\p{M}]*)")


def evidence(text: str) -> dict[str, Counter]:
    """Counts of the unambiguous occurrences of words, by kind."""
    n = {k: Counter() for k in KINDS}
    for w, times in Counter(_WORDS.findall(text)).items():
        low = w.lower()
        n["plain"][low] += times
        if not w[0].isupper():
            n["lower"][low] += times
    n["opening"].update(w.lower() for w in _OPENING.findall(text))
    n["capital"].update(w.lower() for w in _CAPITAL.findall(text))
    ends = []
    for start, end, listed in paragraphs(text):
        ends.append(start + len(text[start:end].rstrip(CLOSING)))
        first = None if listed else _FIRST.match(text, start, end)
        if first:
            n["opening"][first[1].lower()] += 1
    finals = set(ends)
    for m in _DOTTED.finditer(text):
        low, tail = m[1].lower(), m[2]
        then = tail.lstrip()[:1]
        n["dotted"][low] += 1
        n["plain"][low] -= 1
        if m.end() in finals:
            n["final"][low] += 1
        elif tail[:1] in (",", ";", ":") or (tail[:1].isspace() and then.islower()):
            n["inside"][low] += 1
        elif tail[:1].isspace() and then.isdigit():
            n["numbered"][low] += 1
    return n


#: Of these kinds a document's own counts are asked for.
OWN = ("inside", "plain", "final", "lower", "capital")


class Known:
    """What the document says of the words it asks about, with the corpus counts behind it."""

    def __init__(self, own: dict[str, tuple], corpus: dict[str, tuple]):
        self.mine, self.corpus = own, corpus

    def own(self, kind: str, low: str) -> int:
        counts = self.mine.get(low)
        return counts[OWN.index(kind)] if counts else 0

    def counts(self, low: str) -> dict[str, int]:
        return dict(zip(KINDS, self.corpus.get(low) or (0,) * len(KINDS), strict=True))

    def abbreviation(self, word: str) -> bool:
        """Whether ``word`` is one that takes a period of its own."""
        low, c = word.lower(), self.counts(word.lower())
        if len(word) == 1 or "." in word or self.own("inside", low):
            return True
        if c["inside"] >= 1 and c["inside"] >= PLAIN_SHARE * c["dotted"] and c["plain"] <= c["dotted"]:
            return True
        return not self.own("plain", low) and len(word) <= SHORT and c["dotted"] >= SEEN and c["plain"] <= PLAIN_SHARE * c["dotted"]

    def before_number(self, word: str) -> bool:
        """Whether a number after ``word`` and a period belongs to the word, as in a title or a measure."""
        c = self.counts(word.lower())
        return c["numbered"] >= NUMBER_SHARE * max(1, c["dotted"] - c["inside"] - c["final"]) and c["final"] <= PLAIN_SHARE * c["dotted"]

    def may_end(self, word: str) -> bool:
        """Whether the word with its period is met at the end of paragraphs, so that a sentence can end with it."""
        c = self.counts(word.lower())
        return self.own("final", word.lower()) > 0 or c["final"] > PLAIN_SHARE * c["dotted"] / 2

    def opens(self, word: str) -> bool:
        """Whether a capitalised word opens a sentence, rather than being a name."""
        low, c = word.lower(), self.counts(word.lower())
        if len(word) > 1 and self.own("lower", low) and not self.own("capital", low):
            return True
        return c["lower"] >= OPENS and c["lower"] >= OPEN_SHARE * (c["lower"] + c["capital"])


def _paired(text: str, start: int, end: int) -> list[tuple[int, int, bool]]:
    """Spans of quotations and brackets within a paragraph; an opener without its closer spans nothing."""
    out, stack, straight = [], [], None
    for m in _PAIRS.finditer(text, start, end):
        i, c = m.start(), m[0]
        if c == '"':
            if straight is None:
                straight = i
            else:
                out.append((straight, i, True))
                straight = None
        elif stack and c == stack[-1][1]:
            at, _, quote = stack.pop()
            out.append((at, i, quote))
        elif c in OPENERS:
            stack.append((i, OPENERS[c], c in QUOTES))
    return out


def _ends(text: str, start: int, stop: regex.Match, end: int, known: Known, spans: list) -> int | None:
    """Where the unit ends if ``stop`` ends it."""
    mark = stop[0]
    if mark.isspace():
        return stop.start()
    a, z = stop.span()
    close = _AFTER.match(text, z, end).end()
    holding = [s for s in spans if s[0] < a and s[1] >= z]
    if any(s[1] >= close for s in holding):
        return None
    solid = _SOLID.search(text, close, end)
    if not solid:
        return close
    n = _NEXT.match(text, close, end)
    word = n[1] if n else ""
    spaced, then = text[close].isspace(), solid[0]
    outer = holding and min(holding, key=lambda s: s[0])
    if outer and outer[2]:
        opened_first = not _SOLID.search(text, start, outer[0])
        if not spaced or mark[-1] in FULL and not word[:1].isupper():
            return None
        if then in "—–-,;":
            return None
        if opened_first and not word[:1].isupper():
            return None
    if mark[-1] in FULL:
        return close
    if mark[-1] in "!?‽" or len(mark) > 1 or mark[-1] == "…":
        if not spaced:
            return close if mark[-1] in "…!?‽" and word and not word[0].islower() and not word[0].isdigit() or mark in ("……", "…") and _wide(text, a) else None
        return None if word[:1].islower() or not word and then in ",;:—–)" else close
    before = _TOKEN_BACK.match(text, start, a)
    if not spaced:
        fresh = len(word) > 1 and word[0].isupper() and word[1:].islower() and text[close] == word[0]
        if not fresh or (before and len(before[0]) < 3) or not (before or text[a - 1].isdigit() or close > z):
            return None
        return close if not before or not known.abbreviation(before[0]) or known.may_end(before[0]) else None
    if word[:1].islower() or (not word and then in ",;:—–)"):
        return None
    if close > z or not before:
        ordinal = close == z and _NUMBER.search(text, start, a) and word[:1].isalpha() and _SOLID.search(text, start, a)
        return None if ordinal and not known.opens(word) else close
    if word[:1].isdigit():
        return None if known.before_number(before[0]) or (known.abbreviation(before[0]) and not known.may_end(before[0])) else close
    if not known.abbreviation(before[0]) or (known.may_end(before[0]) and len(before[0]) > 1):
        return close
    single = text.startswith(f"{word}.", solid.start())
    return close if word and word[0].isupper() and known.opens(word) and not (single and len(word) == 1) else None


def _wide(text: str, at: int) -> bool:
    return at > 0 and "⺀" <= text[at - 1] <= "￯"


def units(text: str, corpus: dict[str, tuple], own: dict[str, tuple] | None = None) -> list[tuple[int, int]]:
    """Start and end of every sentence unit, without the white space around it; ``own`` is ``testimony`` of the text."""
    known = Known(testimony(text, evidence(text)) if own is None else own, corpus)
    out = []

    def add(a: int, z: int) -> None:
        part = text[a:z]
        left = len(part) - len(part.lstrip())
        if part.strip():
            out.append((a + left, a + len(part.rstrip())))

    for start, end, listed in paragraphs(text):
        if listed:
            add(start, end)
            continue
        spans = _paired(text, start, end)
        at = start
        for stop in _STOP.finditer(text, start, end):
            if stop.start() < at:
                continue
            cut = _ends(text, at, stop, end, known, spans)
            if cut is not None:
                add(at, cut)
                at = cut
        add(at, end)
    return out


def asked(text: str) -> set[str]:
    """Words of a text whose counts may be needed: those before a period and those after it."""
    words, at = set(), text.find(".")
    while at >= 0:
        words.update(m[0].lower() for m in (_TOKEN_BACK.match(text, 0, at),) if m)
        words.update(m[1].lower() for m in (_NEXT.match(text, at + 1), _NEXT.match(text, _AFTER.match(text, at + 1).end())) if m)
        at = text.find(".", at + 1)
    return words


def testimony(text: str, found: dict[str, Counter]) -> dict[str, tuple]:
    """For each word the text asks about, its own counts of the kinds ``OWN``."""
    return {w: tuple(found[k][w] for k in OWN) for w in asked(text)}


def read(docs: DataFrame) -> DataFrame:
    """word with ``c`` (counts of ``KINDS`` and questions in a batch), or with doc_id, h (hash of the text) and ``own`` (counts of ``OWN``)."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            total, asks, rows = {k: Counter() for k in KINDS}, Counter(), []
            for doc, h, text in zip(pdf["doc_id"], pdf["h"], pdf["text"], strict=True):
                found = evidence(text)
                for k, c in found.items():
                    total[k].update(c)
                own = testimony(text, found)
                asks.update(own.keys())
                rows += [(w, None, doc, h, o) for w, o in own.items()]
            rows += [(w, (*(total[k][w] for k in KINDS), asks[w]), None, None, None) for w in set().union(asks, *total.values())]
            for at in range(0, len(rows), 20_000):
                word, c, doc, h, own = zip(*rows[at : at + 20_000], strict=True)
                yield pd.DataFrame({"word": word, "c": c, "doc_id": pd.array(doc, "Int64"), "h": pd.array(h, "Int64"), "own": own})  # exact beside NULL

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInPandas(look, "word string, c array<long>, doc_id long, h long, own array<int>")


def _totals(found: DataFrame) -> DataFrame:
    """word, c (counts of ``KINDS`` over all documents), asks (documents that ask about it), of words that stand dotted, opening or capitalised anywhere."""
    parts = found.where("c is not null").select("word", *(F.col("c")[i].alias(k) for i, k in enumerate((*KINDS, "asks"))))
    total = parts.groupBy("word").agg(*(F.sum(k).alias(k) for k in (*KINDS, "asks"))).where("dotted > 0 or opening > 0 or capital > 0")
    return total.select("word", F.array(*KINDS).alias("c"), "asks")


def corpus_counts(docs: DataFrame) -> DataFrame:
    """word, c (array of the counts of ``KINDS``) over all documents, of words that stand dotted, opening or capitalised anywhere."""
    return _totals(read(docs.select("text", F.lit(0).cast("long").alias("doc_id")))).select("word", "c")


def sentence_units(docs: DataFrame) -> DataFrame:
    """doc_id, sent_start, sent_end of every sentence unit of every document."""
    texts = docs.select("doc_id", "text").where("text is not null and trim(text) != ''")
    found = cut(read(texts))
    corpus = cut(_totals(found).where("asks > 0"))
    questions = found.where("c is null").select("word", "doc_id", "h", "own")
    least = (corpus.agg(F.sum("asks")).first()[0] or 0) / FREQUENT
    frequent = corpus.where(F.col("asks") >= least).select("word", "c")
    often = questions.join(F.broadcast(frequent), "word", "left")
    rest = often.where("c is null").drop("c").join(corpus.where(F.col("asks") < least).select("word", "c"), "word", "left")
    answers = often.where("c is not null").unionByName(rest)
    facts = answers.groupBy(F.col("doc_id").alias("of_doc"), F.col("h").alias("of_h")).agg(F.collect_list(F.struct("word", "own", "c")).alias("facts"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text, known in zip(pdf["doc_id"], pdf["text"], pdf["facts"], strict=True):
                known = known if known is not None else ()
                corpus = {f["word"]: tuple(f["c"]) for f in known if f["c"] is not None}
                rows += [(doc, a, z) for a, z in units(text, corpus, {f["word"]: tuple(f["own"]) for f in known})]
            yield pd.DataFrame(rows, columns=["doc_id", "sent_start", "sent_end"])

    hashed = texts.withColumn("h", F.xxhash64("text"))
    same = hashed["doc_id"].eqNullSafe(F.col("of_doc")) & (hashed["h"] == F.col("of_h"))
    return hashed.join(facts, same, "left").select("doc_id", "text", "facts").mapInPandas(split, "doc_id long, sent_start int, sent_end int")
