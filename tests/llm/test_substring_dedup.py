"""Content-defined chunks: resistance to shifts, planted passages, what stays, defined cases."""

import random

import numpy as np

from citeloom.llm import substring_dedup as sd


def bytes_of(t):
    return np.frombuffer(t.encode(), np.uint8)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_cuts_cover_the_text_and_resist_insertions():
    rng = random.Random(1)
    t = prose(rng, 4000)
    a = sd.cuts(bytes_of(t), np.array([0, len(t)]))
    moved = "some inserted words " + t
    b = sd.cuts(bytes_of(moved), np.array([0, len(moved)]))
    assert a[0] == 0 and (np.diff(a) <= sd.LONGEST).all() and 15 < np.diff(a).mean() < 45
    assert len(set(a[2:].tolist()) - {x - 20 for x in b.tolist()}) <= 3


def test_cuts_do_not_depend_on_neighbouring_rows():
    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(0, 80)) for _ in range(30)]
    whole = bytes_of("".join(texts))
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together = sd.cuts(whole, offsets)
    alone = np.concatenate([sd.cuts(bytes_of(t), np.array([0, len(t)])) + o for t, o in zip(texts, offsets)])
    assert together.tolist() == alone.tolist()


def test_planted_passages_go_but_for_the_first(spark, docs):
    rng = random.Random(3)
    passages = [prose(rng, 60) for _ in range(10)]
    texts = []
    for k in range(120):
        body = prose(rng, 100)
        texts.append(f"{body} {passages[k % 10]} {prose(rng, 40)}" if k < 60 else body)
    got = {r["doc_id"]: r for r in sd.report(docs(texts)).collect()}
    assert all(not got[k]["repeated"] for k in [*range(10), *range(60, 120)])
    assert all(got[k]["repeated"] for k in range(10, 60))
    for k in range(10, 60):
        (span,) = got[k]["spans"]
        gone = texts[k].encode()[span["start"] : span["end"]].decode()
        # an edge may also hold letters that follow the passage in another copy
        assert gone[20:-20] in texts[k % 10] and len(gone.split()) >= 25
    kept = {r["doc_id"]: r["text"] for r in sd.without_repeats(docs(texts)).collect()}
    assert all(kept[k] == texts[k] for k in range(10)) and len(kept) == 120


def test_whole_copies_and_defined_cases(spark, docs):
    rng = random.Random(4)
    t = prose(rng, 200)
    texts = [t, t, None, "", "  ", "short words", "short words", "ü" * 5000, prose(rng, 30_000)]
    kept = {r["doc_id"]: r["text"] for r in sd.without_repeats(docs(texts, lang=["x"] * 9)).collect()}
    assert 1 not in kept and {k: kept[k] for k in (0, 2, 3, 4, 5, 6, 8)} == {k: texts[k] for k in (0, 2, 3, 4, 5, 6, 8)}
    assert sd.report(docs(texts).where("false")).count() == 0


def test_rows_that_share_an_id_or_lack_one(spark):
    rng = random.Random(5)
    t, u = prose(rng, 100), prose(rng, 100)
    df = spark.createDataFrame([(1, t, 1), (1, t, 2), (None, t, 3), (2, u, 4), (2, f"{t} {u}", 5)], "doc_id bigint, text string, places int")
    got = {r["places"]: r["text"] for r in sd.without_repeats(df).collect()}
    assert got[1] == got[2] == got[3] == t and len(got[5]) < len(t) + len(u)


def test_many_copies_send_few_rows(spark, docs, monkeypatch):
    rng = random.Random(6)
    t = prose(rng, 80)
    out = sd.report(docs([t] * 500))
    assert out.where("repeated").count() == 499


def by_dictionary(rows, min_words=20):
    """(n_chunks, n_duplicates, removed spans) of each row by a plain dictionary of chunks."""
    first, out = {}, {}
    for i, t in sorted(rows):
        b = t.encode()
        starts = sd.cuts(bytes_of(t), np.array([0, len(b)])).tolist()
        marked, spans = [], []
        for x, y in zip(starts, [*starts[1:], len(b)], strict=True):
            marked.append(first.setdefault(b[x:y], (i, x)) != (i, x))
        k = 0
        while k < len(marked):
            j = k
            while j < len(marked) and marked[j]:
                j += 1
            x, y = starts[k] if k < len(starts) else 0, starts[j] if j < len(starts) else len(b)
            if j > k and len(b[x:y].split()) >= min_words:
                spans.append((x, y))
            k = max(j, k + 1)
        out[i] = (len(starts), sum(marked), spans)
    return out


def test_against_a_dictionary_of_chunks(spark, docs, monkeypatch):
    rng = random.Random(7)
    passages = [prose(rng, 50) for _ in range(5)]
    texts = [" ".join([prose(rng, rng.randrange(60)), rng.choice(passages), prose(rng, rng.randrange(60))]) for _ in range(200)]
    texts += [" ".join(rng.choices(["in", "of", "the"], k=400)) for _ in range(5)] + ["Heti " * 300, "so " + "Heti " * 200]
    want = by_dictionary(list(enumerate(texts)))
    order = list(range(len(texts)))
    rng.shuffle(order)
    df = docs(texts).repartition(5)
    for slots in (sd.SLOTS, 16):
        monkeypatch.setattr(sd, "SLOTS", slots)
        got = {r["doc_id"]: (r["n_chunks"], r["n_duplicate_chunks"], [tuple(s) for s in r["spans"]]) for r in sd.report(df).collect()}
        assert got == want


def test_periodic_text_is_cut_alike_wherever_it_begins(spark, docs):
    rng = random.Random(8)
    texts = [prose(rng, 50) + " " + "Heti " * 200, prose(rng, 31) + " " + "Heti " * 300 + prose(rng, 20), prose(rng, 80)]
    got = {r["doc_id"]: r["text"] for r in sd.without_repeats(docs(texts)).collect()}
    assert got[2] == texts[2] and got[0].count("Heti") < 40 and got[1].count("Heti") < 40


def test_text_ids(spark):
    rng = random.Random(9)
    t = prose(rng, 100)
    df = spark.createDataFrame([("a", t), ("b", t), ("c", prose(rng, 50))], "doc_id string, text string")
    assert sorted(r["repeated"] for r in sd.report(df).collect()) == [False, False, True]
