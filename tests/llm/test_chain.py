"""The whole pipeline on a small table against a brute-force version of every stage, one after the other."""

import random
import re
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import test_lines, test_near

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def planted():
    rng = random.Random(21)
    words = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    text = lambda lines: "\n".join(" ".join(x) for x in lines)
    passage, shared, rows = words(70), " ".join(words(9)), []
    for i in range(30):
        lines = [words(rng.randint(30, 60)) for _ in range(3)]
        if i % 5 == 1:
            lines[1] = lines[1][:10] + passage + lines[1][10:]
        if i % 7 == 2:
            lines.insert(1, shared.split() if i % 2 else [*shared.split()[:4], "other", *shared.split()[5:]])
        rows.append((i, text(lines), f"s{i % 3}"))
    near = [words(100) for _ in range(4)]
    rows.append((40, text(near), "s0"))
    for i in (41, 43):
        rows.append((i, text([[w if k % 50 != i % 40 else f"x{i}" for k, w in enumerate(line)] for line in near]), "s1"))
    rows += [(50, " ".join(words(20)), "s1"), (51, "a b c " * 40, "s2"), (52, rows[3][1], "s0"), (53, None, "s1"), (54, "", None), (55, text([words(60), ["#"] * 3]), None), (56, " ".join(words(3000)), "s2")]
    return rows


def good(rows):
    out = []
    for d, t, s in rows:
        w = WORD.findall(t or "")
        seen, n = {}, len(w)
        for k in range(n - 2):
            seen.setdefault(tuple(w[k : k + 3]), []).append(k)
        inside = {k + j for places in seen.values() if len(places) > 1 for k in places for j in range(3)}
        if n >= 50 and 100 * len(inside) <= 50 * n:
            out.append((d, t, s))
    return out


def first_lines(rows):
    source = {d: s for d, _, s in rows}
    done = test_lines.brute([(d, t) for d, t, _ in rows])
    return [(d, t, source[d]) for d, t, _, removed in done if removed == 0 or WORD.search(t or "")]


def one_of_each(rows):
    kept = {d for d, _, _, keep in test_near.brute_docs([(d, t) for d, t, _ in rows]) if keep}
    return [r for r in rows if r[0] in kept]


def without_passages(rows, least=50):
    """Longest equal stretches with an earlier text; in random words nothing else is alike."""
    out, earlier = [], []
    for d, t, s in sorted(rows):
        spans = [m.span() for m in WORD.finditer(t)]
        w = [t[a:b] for a, b in spans]
        gone = np.zeros(len(w), bool)
        for other in earlier:
            place = {}
            for k, x in enumerate(other):
                place.setdefault(x, []).append(k)
            run = {}
            for i, x in enumerate(w):
                run = {j: run.get(j - 1, 0) + 1 for j in place.get(x, ())}
                for n in run.values():
                    if n >= least:
                        gone[i - n + 1 : i + 1] = True
        earlier.append(w)
        if len(w) and gone.all():
            continue
        edges = [a for a, _ in spans] + [len(t)]
        out.append((d, t[: edges[0]] + "".join(t[edges[k] : edges[k + 1]] for k in np.flatnonzero(~gone)), s))
    return out


def pieces(rows):
    library, out = Tokenizer.from_file(corpus_pipeline.TOKENIZER), []
    for d, t, _ in rows:
        ids, at = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4"), 0
        for n in [2048] * (len(ids) // 2048) + [1 << b for b in range(10, -1, -1) if len(ids) % 2048 >> b & 1]:
            out.append((d, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids), 0))
            at += n
    return out


def test_the_whole_chain_equals_brute_force(spark, tmp_path):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    brute = {"quality_rules": good, "line_dedup": first_lines, "ngram_join": one_of_each, "substring_dedup": without_passages}
    docs, want, sizes = df, rows, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, want = stage(spark, docs, str(tmp_path)), brute[name](want)
        assert sorted(map(tuple, docs.collect())) == sorted(want), name
        sizes.append((len(want), sum(len(t) for _, t, _ in want)))
    assert len(set(sizes)) == 4  # every stage takes something away
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset", "sequence_id").collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted(pieces(want)) and sorted(r.sequence_id for r in got) == list(range(len(got)))
