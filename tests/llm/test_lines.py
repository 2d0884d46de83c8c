"""Line dedup against brute force over all pairs of lines."""

import random
import re

from mossveil.llm import lines


def words(line):
    """Words; code points of scripts without blanks are words."""
    return re.findall(r"[฀-໿぀-ヿ一-鿿]|[^\x20\x09-\x0D฀-໿぀-ヿ一-鿿]+", line)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, similarity=0.8):
    earlier, out = [], []
    for doc, text in sorted(rows):
        kept, split = [], text.split("\n")
        mine = []
        for line in split:
            w = words(line)
            allowed = lambda o: 1 <= (1 - similarity) * max(len(w), len(o)) + 1e-9
            drop = w and any(w == o or o and abs(len(w) - len(o)) < 2 and allowed(o) and edits(w, o) < 2 for o in earlier + mine)
            mine.append(w)
            if not drop:
                kept.append(line)
        earlier += mine
        out.append((doc, "\n".join(kept), len(split), len(split) - len(kept)))
    return sorted(out)


def near_lines(seed, docs=40):
    rng = random.Random(seed)
    pool = [[f"w{rng.randrange(40)}" for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 12, 20]))] for _ in range(25)]
    rows = []
    for d in range(docs):
        out = []
        for _ in range(rng.randint(1, 6)):
            w = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                kind = rng.randrange(3)
                w[k : k + (kind != 0)] = ["new" + str(rng.randrange(9))] if kind != 2 else []
                w = w or ["z"]
            out.append(rng.choice([" ", "  ", "\t"]).join(w))
        rows.append((d, "\n".join(out)))
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    for seed, similarity in ((1, 0.8), (2, 0.0), (3, 0.9)):
        rows = near_lines(seed)
        got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), similarity).collect())
        assert got == brute(rows, similarity)


def test_equals_brute_force_on_a_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 60").select("doc_id", "text")
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(docs).collect())
    assert got == brute([tuple(r) for r in docs.collect()])


def test_odd_rows_and_columns(spark):
    line = "one two three four five six seven eight"
    rows = [(1, line, "a", 9), (2, None, "b", 9), (3, "", "c", 9), (None, line, "d", 9), (4, line, "e", 9), (4, line, "e", 9), (5, "\n" + line.replace("two", "2") + "\n\n", "f", 9), (6, "only three words\nonly three words", "g", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, line_no string, n_lines int")
    done = lines.dedup_lines(df)
    assert done.columns == ["doc_id", "text", "line_no", "n_lines", "n_removed"]
    got = sorted(((r.doc_id or 0, r.text, r.line_no, r.n_lines, r.n_removed) for r in done.collect()), key=repr)
    assert got == sorted([(1, line, "a", 1, 0), (2, None, "b", 0, 0), (3, "", "c", 1, 0), (0, line, "d", 1, 0), (4, "", "e", 1, 1), (4, "", "e", 1, 1), (5, "\n\n", "f", 4, 1), (6, "only three words", "g", 2, 1)], key=repr)
    assert sorted((r.doc_id or 0) for r in lines.keep_first_lines(df).collect()) == [0, 1, 2, 3, 6]
    assert lines.keep_first_lines(df).columns == df.columns
    assert lines.dedup_lines(df.limit(0)).collect() == []


def test_within_one_edit():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.choice("ab") for _ in range(rng.randint(0, 5))] for _ in range(2))
        assert lines.within_one_edit(a, b) == (edits(a, b) < 2)


def test_every_line_equals_brute_force(spark):
    seven = "a b c d e f g"
    rows = near_lines(4) + [(100, f"Read more\n{seven}\n東京都の天気は今日も晴れです\nhttp://a.b"), (101, f"Read more\n{seven} h\n東京都の天気は明日も晴れです\nhttp://a.b\n\nkept"), (102, "東京都の天気は今日も晴れです\na b c d e x g\n東京\n 東京\n")]
    got = {r.doc_id: tuple(r) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text", "n_lines", "n_removed").collect()}
    assert [got[d][1] for d in (101, 102)] == ["\nkept", "東京\n"]
    assert sorted(got.values()) == brute(rows)


def test_query_and_stage_take_every_line(spark, tmp_path):
    import corpus_pipeline
    from mossveil.llm import queries

    rows = [(1, "Read more\nfirst"), (2, "Read more\nsecond"), (3, "第二次世界大戦"), (4, "第二次世界大戦")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.n_removed for r in queries.QUERIES["op3_lines"](spark, str(tmp_path)).collect()} == {1: 0, 2: 1, 3: 0, 4: 1}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, df, str(tmp_path)).collect()} == {1: "Read more\nfirst", 2: "second", 3: "第二次世界大戦"}
