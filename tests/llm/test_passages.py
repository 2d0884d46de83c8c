"""Substring dedup: planted passages are found, clean texts left alone, parts against brute force."""

import random

import numpy as np
import pyarrow as pa

from mossveil.llm import passages


def planted(seed=1, docs=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(5000)]
    some = lambda n: rng.choices(vocabulary, k=n)
    exact, fuzzy, short = some(80), some(120), some(30)
    rows, truth = [], {}
    for d in range(docs):
        w = some(rng.randint(60, 200))
        at = rng.randrange(len(w))
        kind = d % 6
        if kind in (1, 2, 3):
            p = list({1: exact, 2: fuzzy, 3: short}[kind])
            if kind == 2:
                for _ in range(8):
                    k = rng.randrange(len(p))
                    p[k : k + rng.randrange(2)] = some(rng.choice([0, 1]))
            truth[d] = (kind, at, at + len(p))
            w[at:at] = p
        rows.append((d, rng.choice([" ", "\n", "  "]).join(w)))
    return rows, truth


def test_finds_planted_passages_and_nothing_else(spark):
    rows, truth = planted()
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    first = {k: min(d for d, t in truth.items() if t[0] == k) for k in (1, 2)}
    want = {d for d, t in truth.items() if t[0] in first and d != first[t[0]]}
    assert {r.doc_id for r in got} == want
    covered = {d: np.zeros(400, bool) for d in want}
    for r in got:
        kind, a, b = truth[r.doc_id]
        assert truth[r.src_doc_id][0] == kind and r.src_doc_id < r.doc_id
        assert a - 8 <= r.start and r.end <= b + 8 and r.end - r.start >= 50
        assert r.matched >= 0.8 * max(r.end - r.start, r.src_end - r.src_start)
        covered[r.doc_id][r.start : r.end] = True
    for d in want:
        kind, a, b = truth[d]
        assert covered[d][a:b].mean() >= (1.0 if kind == 1 else 0.8)


def test_cutting_keeps_the_earliest_and_the_rest_of_texts(spark):
    rows, truth = planted(2, 24)
    rows += [(100, rows[0][1]), (101, None), (102, ""), (103, "few words"), (None, rows[0][1])]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, src string, place int")
    done = passages.cut_passages(df)
    assert done.columns == df.columns
    got = {r.doc_id: r.text for r in done.collect()}
    assert 100 not in got and len(got) == len(rows) - 1
    first = min(d for d, t in truth.items() if t[0] == 1)
    for d, text in rows:
        if d in truth and truth[d][0] == 1 and d != first:
            w = text.split()
            assert got[d].split() == w[: truth[d][1]] + w[truth[d][2] :]
        elif d not in truth and d != 100:
            assert got[d] == text
    assert passages.repeated_passages(df.limit(0)).collect() == []


def test_rows_that_share_an_id_but_not_the_text_are_documents_of_their_own(spark):
    rng = random.Random(9)
    word = lambda n: " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))
    passage, head, other = word(80), word(20), word(200)
    rows = [(1, passage, 1), (2, f"{head} {passage}", 2), (2, other, 3), (2, f"{head} {passage}", 4), (3, other, 5), (0, other + " x", 6), (0, word(60), 7), (5, None, 8), (5, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").selectExpr("*", "1 as `a``b`", "2 as `c.d`", "3 as _row", "4 as doc", "5 as c1")
    found = {(r.doc_id, r.start, r.end, r.src_doc_id) for r in passages.repeated_passages(df).collect()}
    assert found == {(2, 20, 100, 1), (2, 0, 200, 0), (3, 0, 200, 0)}
    got = passages.cut_passages(df)
    assert got.columns == df.columns
    # Of the second row and its repetition the head is left; the other row of that id goes, as an earlier document holds all of it.
    assert {r.n: r.text.strip() if r.text else r.text for r in got.collect()} == {1: passage, 2: head, 4: head, 6: rows[5][1], 7: rows[6][1], 8: None, 9: ""}
    three = df.where("n in (1, 2, 3)")
    assert {r.n: r.text.strip() for r in passages.cut_passages(three).collect()} == {1: passage, 2: head, 3: other}


def test_a_kmer_is_a_seed_everywhere_or_nowhere():
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefgh", k=n)) for n in (0, 3, 5, 9, 14, 15, 80, 9000)] + [None]
    owner, place, seed = passages.seeds(pa.array(texts))
    chosen, every = set(), set()
    mine = set(zip(owner.tolist(), place.tolist()))
    for i, t in enumerate(texts):
        w = (t or "").split()
        for k in range(len(w) - passages.K + 1):
            every.add(tuple(w[k : k + passages.K]))
            if (i, k) in mine:
                chosen.add(tuple(w[k : k + passages.K]))
    assert all((i, k) in mine for i, t in enumerate(texts) for k in range(len((t or "").split()) - passages.K + 1) if tuple(t.split()[k : k + passages.K]) in chosen)
    assert abs(len(chosen) / len(every) - passages.FRACTION) < 0.03 and len(set(seed.tolist())) == len(chosen)


def test_chains_score_as_the_quadratic_recurrence():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(2, 40))
        p, q = rng.integers(0, 60, n), rng.integers(0, 60, n)
        score = np.zeros(n)
        for i in sorted(range(n), key=lambda i: (p[i], -q[i])):
            earlier = [score[j] - passages.GAP_COST * (p[i] + q[i] - p[j] - q[j]) for j in range(n) if p[j] < p[i] and q[j] < q[i]]
            score[i] = passages.K + max([0.0, *earlier])
        found = passages.chains(p, q)
        assert sorted(np.concatenate(found).tolist()) == list(range(n))
        top = max((sum(passages.K for _ in c) - passages.GAP_COST * (p[c[-1]] + q[c[-1]] - p[c[0]] - q[c[0]])) for c in found)
        assert all((np.diff(p[c]) > 0).all() and (np.diff(q[c]) > 0).all() for c in found)
        assert top == score.max() or np.isclose(top, score.max())


def test_common_words_is_a_longest_common_subsequence():
    rng = np.random.default_rng(5)
    for _ in range(100):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(1, 9))
        x, y = passages.common_words(a, b, 0, 0)
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        assert len(x) == best[-1, -1] and (a[x] == b[y]).all() and (np.diff(x) > 0).all() and (np.diff(y) > 0).all()


def covered_words(got, doc):
    return {k for r in got if r.doc_id == doc for k in range(r.start, r.end)}


def test_passages_whose_sentences_stand_alone_in_earlier_documents(spark):
    rng = random.Random(6)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, truth = [], []
    for case in range(60):
        a, b, at = some(30), some(30), 10 * case
        left, right = [some(rng.randint(5, 60)) for _ in range(2)], [some(rng.randint(5, 60)) for _ in range(2)]
        singles = [some(20) + a + some(20), some(20) + b + some(20)]
        copies = [left[k] + a + b + right[k] for k in range(2)]
        rows += [(at + k, " ".join(w)) for k, w in enumerate(singles + copies)]
        truth.append((at + 3, at + 2, len(left[1])))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.src_doc_id) for r in got} == {t[:2] for t in truth}
    assert all(set(range(at, at + 60)) <= covered_words(got, doc) for doc, _, at in truth)


def test_recall_of_short_passages_with_many_changes(spark):
    rng = random.Random(7)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, truth = [], []
    for case in range(400):
        n, at = rng.randint(50, 60), rng.randint(5, 60)
        passage = some(n)
        copy = list(passage)
        # The first and last word stay, so the whole passage is alike by 0.80 to 0.85.
        for k in rng.sample(range(1, n - 1), rng.randint(-(-15 * n // 100), n // 5)):
            copy[k] = some(1)[0]
        rows += [(2 * case, " ".join(some(40) + passage + some(40))), (2 * case + 1, " ".join(some(at) + copy + some(40)))]
        truth.append((2 * case + 1, at, at + n, sum(a == b for a, b in zip(passage, copy))))
    assert all(matched >= 0.8 * (b - a) for _, a, b, matched in truth)  # by brute force, every one is a passage
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.src_doc_id for r in got} <= {d - 1 for d, *_ in truth} and all(r.src_doc_id == r.doc_id - 1 for r in got)
    recall = sum(len(covered_words(got, d) & set(range(a, b))) >= 0.8 * (b - a) for d, a, b, _ in truth) / len(truth)
    print(f"recall {recall}")
    assert recall >= 0.95


def brute_force(rows, size=50, least=40):
    """For each document, the words of stretches of ``size`` that equal their counterparts in a stretch of an earlier
    one, where at least ``least`` of the stretch do."""
    numbers, flat, starts = {}, [], []
    rows = sorted(rows)
    for _, text in rows:
        starts.append(len(flat))
        flat += [numbers.setdefault(w, len(numbers)) for w in (text or "").split()] + [-1] * size
    flat, out = np.array(flat, np.int32), {}
    for (doc, _), start, end in zip(rows, starts, [*starts[1:], len(flat)]):
        words = flat[start : end - size]
        hit = np.zeros(len(words), bool)
        before = flat[:start]
        sums = [np.zeros(len(before) + 1, np.int16)]
        for i, w in enumerate(words):  # sums[i + 1][j + 1]: equal words along the diagonal up to i and j
            now = np.zeros(len(before) + 1, np.int16)
            now[1:] = sums[-1][:-1] + (before == w)
            sums.append(now)
            if i + 1 >= size and len(before) >= size:
                equal = now[size:] - sums[-1 - size][:-size]
                j = int(equal.argmax())
                if equal[j] >= least:
                    hit[i + 1 - size : i + 1] |= words[i + 1 - size : i + 1] == before[j : j + size]
                sums[-1 - size] = None
        out[doc] = hit
    return out


def compared(spark, rows):
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    truth, texts = brute_force(rows), {d: (t or "").split() for d, t in rows}
    found = {d: np.zeros(len(t), bool) for d, t in texts.items()}
    for r in got:
        found[r.doc_id][r.start : r.end] = True
        a, b = texts[r.doc_id][r.start : r.end], texts[r.src_doc_id][r.src_start : r.src_end]
        x, _ = passages.common_words(np.array([hash(w) for w in a]), np.array([hash(w) for w in b]), 0, 0)
        assert len(x) >= r.matched >= 0.8 * max(len(a), len(b)) and len(a) >= 50
    total = sum(t.sum() for t in truth.values())
    return sum((found[d] & t).sum() for d, t in truth.items()) / total, total


def test_recall_against_brute_force_on_scattered_and_fuzzy_passages(spark):
    rng = random.Random(8)
    some = lambda n: rng.choices([f"w{i}" for i in range(3000)], k=n)
    sentences, passages_of = [some(rng.randint(6, 30)) for _ in range(30)], []
    for _ in range(12):
        passages_of.append(sum(rng.sample(sentences, 5), []))
    rows = []
    for d in range(120):
        w = some(rng.randint(20, 60))
        for _ in range(2):
            p = list(rng.choice(passages_of)) if rng.random() < 0.6 else list(rng.choice(sentences))
            for k in rng.sample(range(len(p)), rng.choice([0, 0, len(p) // 20, len(p) // 8])):
                p[k] = some(1)[0]
            w += p + some(rng.randint(5, 30))
        rows.append((d, " ".join(w)))
    recall, total = compared(spark, rows)
    print(f"recall {recall} of {total} words")
    assert total > 5000 and recall >= 0.95


def test_recall_against_brute_force_on_a_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    recall, total = compared(spark, rows)
    print(f"recall {recall} of {total} words")
    assert total > 1000 and recall >= 0.95


def test_a_pair_that_recurs_in_a_document_is_one_row_of_it(spark, monkeypatch):
    rng, made = random.Random(5), {}
    keep = lambda df, what: made.setdefault(what, df.localCheckpoint())
    monkeypatch.setattr(passages, "saved", keep)
    monkeypatch.setattr(passages, "discard", lambda *frames: None)
    period = [f"r{i}" for i in range(7)]
    rows = [(d, " ".join([f"d{d}x{i}" for i in range(20)] + period * rng.randint(30, 40))) for d in range(6)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), fraction=1).collect()
    pairs = made["pairs"].groupBy("doc_id", "pair").count().agg({"count": "max"}).first()[0]
    assert pairs == 1 and made["pairs"].count() <= 6 * 60
    assert {r.doc_id for r in got} == set(range(1, 6)) and all(r.start >= 20 for r in got)


def test_every_kmer_is_looked_at(spark):
    rng = random.Random(11)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for case in range(80):
        passage = some(53)
        copy = [some(1)[0] if k % 6 == 5 else w for k, w in enumerate(passage)]  # nine runs of five words, one seed each
        rows += [(2 * case, " ".join(some(20) + passage + some(20))), (2 * case + 1, " ".join(some(30) + copy + some(20)))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start, r.end, r.src_doc_id, r.matched) for r in got) == [(2 * c + 1, 30, 83, 2 * c, 45) for c in range(80)]


def test_chains_of_runs_are_the_chains_of_their_matches():
    rng = np.random.default_rng(12)
    places = lambda found: sorted(sorted(zip(x.tolist(), y.tolist())) for x, y in found)
    for t in range(400):
        p, q, x, y = 0, 0, [], []
        for _ in range(int(rng.integers(2, 8))):
            n = int(rng.integers(1, 9))
            x, y = [*x, *range(p, p + n)], [*y, *range(q, q + n)]
            p, q = p + n + int(rng.integers(t % 2, 90)), max(0, q + n + int(rng.integers(-20 * (t % 3 == 0), 40)))
        both = np.unique(np.array(x) << 32 | np.array(y))
        x, y = both >> 32, both & 0xFFFFFFFF
        found = passages.chains_of_runs(*passages.runs(x, y))
        assert places((passages.spread(a, n), passages.spread(b, n)) for a, b, n in found) == places((x[c], y[c]) for c in passages.chains(x, y))


def test_parts_of_the_seeds_and_dense_stretches():
    rng = random.Random(13)
    words, before = passages.short_words(pa.array([" ".join(rng.choices("abcdefgh", k=n)) for n in (0, 4, 5, 9, 90, 900)] + [None]))
    of = lambda *args: list(zip(*[c.tolist() for c in passages.seeds_of(words, before, *args)]))
    assert sorted(sum((of(1, k, 3) for k in range(3)), [])) == sorted(of(1)) and len(of(1)) == 1 + 5 + 86 + 896
    equal = np.random.default_rng(14).random((300, 30)) < 0.75
    brute = [any(row[i:j].mean() >= 0.8 for i in range(31) for j in range(i + 12, 31)) for row in equal]
    assert passages.holds_dense(equal, 12, 0.8).tolist() == brute and 30 < sum(brute) < 270
    assert not passages.holds_dense(equal, 31, 0.8).any()


def test_a_text_that_repeats_itself_has_one_row_of_matches_for_each_earlier_document(spark, monkeypatch):
    made = {}
    monkeypatch.setattr(passages, "saved", lambda df, what: made.setdefault(what, df.localCheckpoint()) if what == "pairs" else df.localCheckpoint())
    monkeypatch.setattr(passages, "discard", lambda *frames: None)
    rows = [(d, " ".join([f"d{d}x{i}" for i in range(20)] + [f"r{i}" for i in range(7)] * 40)) for d in range(5)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(covered_words(found, d) == set(range(20, 300)) for d in range(1, 5)) and not covered_words(found, 0)
    assert made["pairs"].where("pair IS NULL").groupBy("doc_id", "src").count().where("count > 1").isEmpty()
