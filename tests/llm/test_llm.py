"""The text and record operators on small made-up tables, edge cases included."""

import datetime as dt
import random

import numpy as np
import pytest

from chronoloom.llm import contamination, overlap, packing, sentences

T0 = dt.datetime(2024, 1, 1)
PRED = "row_id long, stage_split string, asset_id string, timestamp timestamp_ntz, batch_id int, action_key string, y_true int, y_pred int, prob_class_0 double, prob_class_1 double, prob_class_2 double, prob_class_3 double"


def test_overlap_matches_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        p = [round(rng.random(), 2) for _ in range(4)] if rng.random() < 0.5 else [0.25, 0.25, 0.3, 0.2]
        p = [x + rng.choice((0, 0, 0.01, -0.01, 0.0099)) for x in p]
        rows.append((i, rng.choice(("train", "train", "valid", "test")), rng.choice("ab"), T0 + dt.timedelta(seconds=rng.choice((0, 449, 450, 451, 900, 7199, 7201)) + 900 * rng.randrange(6)), None, rng.choice("xy"), 0, 0, *p))
    rows.append((5000, "train", None, T0, None, "x", 0, 0, 0.25, 0.25, 0.3, 0.2))
    rows.append((5001, "valid", "a", T0, None, "x", 0, 0, None, 0.25, 0.3, 0.2))
    rows.append((5002, "test", "a", None, None, "x", 0, 0, 0.25, 0.25, 0.3, 0.2))
    got = [(r.row_id_a, r.row_id_b) for r in overlap.pairs(spark.createDataFrame(rows, PRED)).collect()]
    want = set()
    for a in rows[:900]:
        for b in rows[:900]:
            if a[1] == "train" and b[1] != "train" and a[2] == b[2] and a[5] == b[5] and abs((a[3] - b[3]).total_seconds()) < 450 and all(abs(x - y) <= 0.01 + 1e-9 for x, y in zip(a[8:], b[8:], strict=True)):
                want.add((min(a[0], b[0]), max(a[0], b[0])))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_overlap_empty(spark):
    assert overlap.pairs(spark.createDataFrame([], PRED)).count() == 0


WORDS = "amber basin cradle drum ember furnace gasket harbour index jagged kettle lantern mortar needle orchard prism quill rudder saddle thimble".split()


def passage(seed, n=40):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice(WORDS)}{rng.randrange(100)}" for _ in range(n))


def items(*passages, lang="en"):
    return tuple((i, lang, p) for i, p in enumerate(passages))


def ids(text, its):
    return sorted(i for i, _, _ in contamination.leaks(text, *contamination.automaton(its)))


def test_leaks_runs_of_fifteen_words():
    its = items(passage(1), passage(2))
    w = passage(1).split()
    assert ids("Intro text. " + " ".join(w[7:22]).upper() + " and more", its) == [0]
    assert ids("Intro text. " + " ".join(w[7:21]) + " and more", its) == []
    assert ids("x " + " -- ".join(f"<b>{x}</b>," for x in w[3:18]) + "\n y", its) == [0]


def test_leaks_edited_and_reordered_passages():
    p = passage(3, 60)
    w = p.split()
    edited = [("changed" if i % 9 == 4 else x) for i, x in enumerate(w) if i % 17 != 11]
    assert ids(" ".join(edited), items(p, passage(4, 60))) == [0]
    parts = [w[i : i + 12] for i in range(0, 60, 12)]
    assert ids("\n\n".join(" ".join(parts[i]) for i in (3, 0, 4, 2, 1)), items(p)) == [0]


def test_leaks_dense_scripts_and_offsets():
    p = "直到雨季铜铃曲线第次转向应在档之前减仓铜铃石桥持有手灯塔盐井的交易员倘若号席位拒收"
    its = ((1, "zh", p),)
    text = "前言。" + p[:12] + "，\n" + p[12:26] + "。后记"
    (item, start, end), = contamination.leaks(text, *contamination.automaton(its))
    assert item == 1 and text[start] == p[0] and text[end - 1] == p[25]
    assert contamination.leaks("前言。" + p[:20], *contamination.automaton(its)) == []


def test_contaminated_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "   \n"), (4, passage(1)), (4, passage(1)), (5, "x" * 200_000)], "doc_id long, text string")
    its = spark.createDataFrame([(0, "en", passage(1)), (1, "en", None), (2, None, "")], "item_id long, lang string, passage string")
    assert [(r.doc_id, r.item_id) for r in contamination.contaminated(docs, its).collect()] == [(4, 0)]
    assert contamination.contaminated(docs, its.limit(0)).count() == 0


def test_packing_is_whole_and_within_capacity(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice((1, 5, 30, 120, 700))))) for i in range(120)] + [(900, None), (901, ""), (902, "word " * 3000)]
    kinds = spark.createDataFrame([("short", 128), ("long", 1024), ("none", None)], "container_kind string, capacity_tokens int")
    got = packing.containers(spark.createDataFrame(docs, "doc_id long, text string"), kinds).toPandas()
    used = got.groupby(["container_kind", "capacity_tokens", "shard", "container"]).n_tokens.sum().reset_index()
    assert (used.n_tokens <= used.capacity_tokens).all()
    tok = packing._tokenizer(packing.TOKENIZER)
    sizes = {i: len(tok.encode_ordinary(t or "")) for i, t in docs}
    for (_, capacity), g in got.groupby(["container_kind", "capacity_tokens"]):
        assert g.groupby("doc_id").n_tokens.sum().to_dict() == sizes
        pieces = g.groupby("doc_id").size()
        assert all(pieces[i] == max(1, -(-s // capacity)) for i, s in sizes.items())
        per = g.groupby(["shard", "container"]).n_tokens.sum()
        assert per.sum() / (len(per) * capacity) > 0.9
    assert packing.containers(spark.createDataFrame([], "doc_id long, text string"), kinds).count() == 0


def test_index_scores_are_bm25():
    ids_ = [np.array(x, dtype=np.uint16) for x in ([1, 2, 2], [2, 3], [4])]
    idf = np.ones(packing.VOCABULARY)
    s = packing.Index(ids_, idf, 2.0).scores(0)
    k = packing.K1 * (1 - packing.B + packing.B * 2 / 2.0)
    assert s[1] == pytest.approx((packing.K1 + 1) / (1 + k)) and s[2] == 0 and s[0] > s[1]


def test_neighbours_are_best_first_and_share_a_place():
    rng = random.Random(2)
    texts = [[1000 + 10 * (i % 7) + rng.randrange(10) for _ in range(60)] + [rng.randrange(900) for _ in range(20)] for i in range(400)]
    ids_ = [np.array(t, dtype=np.uint16) for t in texts]
    frequency = np.bincount(np.concatenate([np.unique(i) for i in ids_]), minlength=packing.VOCABULARY)
    idf = np.log1p((400 - frequency + 0.5) / (frequency + 0.5))
    index = packing.Index(ids_, idf, 80.0)
    assert index.neighbours(3)[0] == 3 and sum(d % 7 == 3 for d in index.neighbours(3)[:50]) >= 45
    vectors = np.stack([packing.vector(i, idf) for i in [*ids_, np.zeros(0, np.uint16)]])
    leaf, _ = packing.placed(vectors, *packing.topic_tree(vectors[:200], 2))
    assert set(leaf) <= {4, 5, 6, 7} and max(np.bincount(leaf[:400])) < 200
    alike = np.mean([np.mean(leaf[index.neighbours(s)[1:11]] == leaf[s]) for s in range(0, 400, 9)])
    assert alike > 0.6  # 0.25 by chance
    assert len(packing.Index([], idf, 1.0).query) == 0


def cut(text, corpus=None):
    return [text[a:b] for a, b in sentences.units(text, corpus or {})]


def test_sentences_rules():
    assert cut("One thing. Two things!  Three?") == ["One thing.", "Two things!", "Three?"]
    assert cut("The gain was 3.5 points. It rose.") == ["The gain was 3.5 points.", "It rose."]
    assert cut("“The gate is open. Let it run,” said Ruvarsk, and it went on. Done.") == ["“The gate is open. Let it run,” said Ruvarsk, and it went on.", "Done."]
    assert cut("He left (see below.) Then he came.") == ["He left (see below.)", "Then he came."]
    assert cut("# Heading\n\nA line\nwraps here. Next.") == ["# Heading", "A line\nwraps here.", "Next."]
    assert cut("Do this:\n- first item. more\n2. second") == ["Do this:", "- first item. more", "2. second"]
    assert cut("") == [] and cut(" \n ") == []


def test_sentences_scripts():
    assert cut("今天下雨。明天呢？“窗口是空的。再等等。”他写道。") == ["今天下雨。", "明天呢？", "“窗口是空的。再等等。”他写道。"]
    assert cut("यह पहला है। यह दूसरा है।") == ["यह पहला है।", "यह दूसरा है।"]
    assert cut("هل هذا صحيح؟ نعم.") == ["هل هذا صحيح؟", "نعم."]
    assert cut("ทดสอบ หนึ่งสอง ของ HIRIR จึง") == ["ทดสอบ", "หนึ่งสอง", "ของ HIRIR จึง"]


def test_sentences_use_the_document_then_the_corpus():
    text = "The approx. values held. We saw approx. Ten of them etc."
    assert cut(text)[0] == "The approx. values held."
    zero = dict.fromkeys(sentences.KINDS, 0)
    corpus = {"dr": tuple({**zero, "dotted": 50}.values()), "uhr": tuple({**zero, "dotted": 50, "final": 20}.values())}
    assert cut("Then Dr. Selanta left. Bye.", corpus) == ["Then Dr. Selanta left.", "Bye."]
    assert cut("Es war 15:14 Uhr. Selanta ging.", corpus) == ["Es war 15:14 Uhr.", "Selanta ging."]


def test_sentence_units_table(spark):
    docs = spark.createDataFrame([(1, "A first one. A second one."), (2, None), (3, "  "), (4, "x" * 100_000)], "doc_id long, text string")
    got = sorted((r.doc_id, r.sent_start, r.sent_end) for r in sentences.sentence_units(docs).collect())
    assert got == [(1, 0, 12), (1, 13, 26), (4, 0, 100_000)]
    assert sentences.sentence_units(docs.limit(0)).count() == 0


def test_long_words_and_frequent_words(spark):
    long = "q" * 90
    assert cut(f"The {long}. values held. We saw {long}. Ten of them.")[0] == f"The {long}. values held."
    docs = [(i, f"It was Dr. Ann who came too late in week {i} too. Then it rained.") for i in range(60)] + [(1, "He left. She did too."), (None, "One. Two.")]
    got = sentences.sentence_units(spark.createDataFrame(docs, "doc_id long, text string")).toPandas()
    counts = got.groupby("doc_id", dropna=False).size()
    assert counts[1] == 4 and counts[7] == 2 and len(got) == 60 * 2 + 2 + 2


def test_items_beyond_one_automaton(spark, monkeypatch):
    docs = spark.createDataFrame([(i, passage(i) if i < 9 else "nothing") for i in range(12)], "doc_id long, text string")
    its = spark.createDataFrame([(i, "en", passage(i)) for i in range(9)], "item_id long, lang string, passage string")
    whole = sorted(map(tuple, contamination.contaminated(docs, its).collect()))
    monkeypatch.setattr(contamination, "MAX_ITEM_CHARS", 700)
    assert sorted(map(tuple, contamination.contaminated(docs, its).collect())) == whole and len(whole) == 9


def test_corpus_counts_do_not_depend_on_partitions(spark):
    from chronoloom.llm import sentences

    texts = [(i, "We saw the abb. Then we left." if i == 0 else "They called abb here and the abb there.") for i in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    count = lambda n: {r.word: list(r.c) for r in sentences.corpus_counts(df.repartition(n, "doc_id")).collect()}
    one = count(1)
    assert one == count(7) == count(40)
    assert one["abb"][sentences.KINDS.index("plain")] == 78
