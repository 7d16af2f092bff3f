"""The Merkle manifest, the compressed id files and the divergence audit against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from standout.llm import common, divergence, merkle, repair

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place long, slot long, path string, term string, rank int"


def documents(spark, rows):
    return spark.createDataFrame([(d, t, la, s, len(t or ""), 1, 2, "p", "t", 3) for d, t, la, s in rows], SCHEMA)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def test_places_in_groups(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), (-F.col("id")).alias("o"), F.lit(1).alias("_x"))
    rows = rows.withColumn("g", F.when(F.col("o") < -100, 0).otherwise(F.col("g")))
    found = common.numbered(rows, ["g"], ["o"], "place", "size").collect()
    for g in (0, 1, 2):
        mine = sorted((r["o"], r["place"], r["size"]) for r in found if r["g"] == g)
        assert [p for _, p, _ in mine] == list(range(len(mine))) and {n for *_, n in mine} == {len(mine)}


def brute_tree(digests):
    """All levels, and the steps (left, right) of each leaf."""
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[i : i + 8]) for i in range(0, len(last), 8)])
    paths = []
    for at in range(len(digests)):
        steps = []
        for level in levels[:-1]:
            first = at - at % 8
            steps.append(("".join(level[first:at]), "".join(level[at + 1 : first + 8])))
            at //= 8
        paths.append(steps)
    return levels[-1][0], paths


@pytest.mark.parametrize("sizes", [(1,), (8,), (9, 1), (520, 65, 64, 1, 7, 2, 3, 3, 1, 1)])
def test_manifest_is_that_of_a_tree_built_in_memory(spark, sizes):
    rows, at = [], 0
    for k, n in enumerate(sizes):
        for _ in range(n):
            rows.append((at * 7 % 1009, f"Text É {at}", None if k == 0 else f"l{k}" if k < 9 else "é", "s" if at % 5 else None))
            at += 1
    listed = merkle.verified(merkle.manifest(documents(spark, rows)), F.col("leaf")).collect()

    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    groups = {}
    for d, t, la, s in rows:
        groups.setdefault(la, []).append((d, sha(*map(field, (d, s, la, len(t), t)))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([h for _, h in sorted(groups[g])]) for g in names}
    root, over = brute_tree([trees[g][0] for g in names])
    want = {d: (h, trees[g][0], root, trees[g][1][i] + over[names.index(g)]) for g in names for i, (d, h) in enumerate(sorted(groups[g]))}
    got = {r["doc_id"]: (r["leaf"], r["subroot"], r["root"], [tuple(x) for x in r["path"]]) for r in listed}
    assert got == want and all(r["verified"] and r["folded_root"] == root for r in listed)


def test_changed_and_equal_rows(spark):
    rows = [(1, "Same", "en", "a")] * 3 + [(2, "é", "en", "a"), (None, None, None, None)]
    listed = merkle.manifest(documents(spark, rows))
    assert listed.count() == 5 and listed.select("root").distinct().count() == 1
    wrong = merkle.verified(listed, F.when(F.col("doc_id") == 2, F.sha2(F.lit("x"), 256)).otherwise(F.col("leaf")))
    assert [r["doc_id"] for r in wrong.where("NOT verified").collect()] == [2]
    low = spark.createDataFrame([("ÀB İ",), ("ABC",), (None,)], "t string").select(merkle.lower_ascii(F.col("t")))
    assert [r[0] for r in low.collect()] == ["Àb İ", "abc", None]


def test_grammars_give_back_any_range():
    rng = random.Random(5)
    phrase = [rng.randrange(300) for _ in range(90)]
    makes = [[], [5], [7] * 1000, [3, 4] * 501, [rng.randrange(6) for _ in range(5000)], phrase * 40, [rng.randrange(300) for _ in range(3000)] + phrase * 20]
    for ids in makes:
        for least in (2, 8):
            grammar = repair.Grammar.of(np.array(ids, np.uint16), 300, least, 1 << 30)
            assert len(grammar) == len(ids) and grammar.decode(0, len(ids)).tolist() == ids
            for _ in range(40):
                a, b = sorted((rng.randrange(len(ids) + 1), rng.randrange(len(ids) + 1)))
                assert grammar.decode(a, b).tolist() == ids[a:b]
            lengths = [len(grammar.decode(0, 0))]
            for i, (x, y) in enumerate(grammar.rules.tolist()):
                assert x < 300 + i and y < 300 + i or max(x, y) < 300 + len(grammar.rules)
                sides = [1 if s < 300 else int(grammar.lengths[s - 300]) for s in (x, y)]
                assert grammar.lengths[i] == sum(sides)
            assert lengths == [0]
    repeated = repair.Grammar.of(np.array(phrase * 40, np.uint16), 300, 8, 1 << 30)
    assert len(repeated.symbols) + 2 * len(repeated.rules) < 0.2 * 3600


def test_no_frequent_pair_is_left():
    rng = random.Random(9)
    ids = np.array([rng.randrange(20) for _ in range(8000)], np.uint16)
    grammar = repair.Grammar.of(ids, 20, 8, 1 << 30)
    seq, used = grammar.symbols.tolist(), Counter()
    i = 0
    while i < len(seq) - 1:  # places of the same pair that do not overlap
        used[tuple(seq[i : i + 2])] += 1
        i += 2 if i + 2 < len(seq) and seq[i] == seq[i + 1] == seq[i + 2] else 1
    assert max(used.values()) < 3 * 8


def test_ids_of_pieces_are_those_of_the_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, own = Tokenizer.from_file(path), repair.PieceTokenizer(path)
    rng = random.Random(1)
    signs = "aAbBsStT'’́̇İKſ½²٣३_-.,!😀日éßΣ \n\t\x0b\x1c\x1f\u0085  ‍ẞǅ가ᄀᆨ\x00"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["don't we'll I'VE x'd", "a <|endoftext|> b", "", "word " * 400, "sixteen-letters. seventeen-letters antidisestablishmentarianism,"]
    want = [np.array([*e.ids, 1], "<u2").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert own.encode([t.encode() for t in texts]) == want
    assert own.encode([t.encode() for t in texts]) == want  # now from the kept units
    assert [own.encode([t.encode()])[0] for t in texts[:300]] == want[:300]


def test_files_hold_all_documents_in_order(spark):
    rng = random.Random(2)
    words = ["alpha", "beta,", "Gamma", "d'Artagnan", "ünï", "42"]
    rows = [(rng.randrange(500) if i % 9 else None, " ".join(rng.choice(words) for _ in range(rng.randrange(60))) if i % 11 else None, "en", "s") for i in range(400)]
    rows.append((250, "long " * 3000, "en", "s"))
    folder = common.new_folder(spark, "test")
    listed = repair.write_ids(documents(spark, rows), folder, shard_ids=1000, least=2)
    assert listed.count() > 8 and listed.agg(F.sum("documents")).first()[0] == len(rows)
    found = sorted(repair.read_ids(listed, folder).collect(), key=lambda r: r["start"])
    plain, at, left = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, Counter((d, t or "") for d, t, *_ in rows)
    by = {(d, np.array([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()): (d, t) for d, t in left}
    for r in found:
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(r["ids"]) and 4 * r["n_tokens"] == len(r["ids"])
        left[by[r["doc_id"], bytes(r["ids"])]] -= 1
        at += r["n_tokens"]
    assert not any(left.values())
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in found]
    assert order == sorted(order)


def test_damaged_files_are_errors():
    grammar = repair.Grammar.of(np.arange(50, dtype=np.uint16), 300)
    data = repair.to_bytes([1, None], [20, 30], grammar)
    shard = repair.Shard(data)
    assert shard.doc_ids == [1, None] and shard.ids(20, 50).tolist() == list(range(20, 50))
    for bad in (data[:-1], data[:10], data[:60] + bytes([data[60] ^ 1]) + data[61:], b""):
        with pytest.raises(ValueError):
            repair.Shard(bad)


def brute_audit(rows, least, top):
    docs = [("" if la is None else la, "" if s is None else s, [w.decode() for w in (t or "").encode().translate(divergence._TERMS).split()]) for _, t, la, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(w for la, _, ws in docs if la == lang for w in set(ws))
        kept = {w for w, n in df.items() if n >= least}
        counts = {s: Counter() for la, s, _ in docs if la == lang}
        for la, s, ws in docs:
            if la == lang:
                counts[s].update(w for w in ws if w in kept)
        whole = sum(counts.values(), Counter())

        def p(of, w):
            return 1 + 1_000_000_000 * (of[w] + 2) // (sum(of.values()) + 2 * len(kept))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in counts:
            pairs = [(-sum(f(p(counts[s], w), p(counts[o], w)) for w in kept), o.encode()) for o in counts if o != s]
            terms = [(-f(p(counts[s], w), p(whole, w)), w.encode()) for w in counts[s] if p(counts[s], w) > p(whole, w)]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, i.decode(), -v, r + 1) for r, (v, i) in enumerate(items)]
    return sorted(out)


def test_audit_is_exact(spark):
    rng = random.Random(4)
    words = [a + b for a in "b c d f g".split() for b in "a e i o É ß x y".split()]
    rows = [
        (i, " ".join(rng.choices(words[: 5 + i % 36], k=rng.randrange(25))) if i % 13 else None, rng.choice(["en", "de", None]), rng.choice("abcdefg") if i % 17 else None)
        for i in range(300)
    ]
    rows += [(1000, "12 !!", "en", "numbers"), (1001, "alone", "xx", "a"), (1002, None, "xx", "b"), rows[0], rows[0]]
    for side in (1024, 4):  # several blocks each way with the small one
        got = sorted(map(tuple, divergence.audit(documents(spark, rows), least_documents=5, top=4, side=side).collect()))
        assert got == brute_audit(rows, 5, 4)


@pytest.mark.parametrize("step", [3, 1 << 17])
def test_pairs_of_quadtrees(monkeypatch, step):
    monkeypatch.setattr(divergence, "STEP", step)
    rng = np.random.default_rng(7)
    for trial in range(12):
        side, rows_a, rows_b, width = 16, *rng.integers(1, 17, 3)
        dense = [np.where(rng.random((n, width)) < 0.2 * (trial % 4), rng.integers(1, 10**9, (n, width)), 0) for n in (rows_a, rows_b)]
        zeros = [rng.integers(1, 1000, n) for n in (rows_a, rows_b)]
        trees = []
        for cells in dense:
            r, c = np.nonzero(cells)
            tree = divergence.QuadTree.build(r, c, cells[r, c], side) if len(r) else None
            trees.append(tree and divergence.QuadTree.from_bytes(tree.to_bytes(), tree.values, side))
        full = [np.where(cells > 0, cells, z[:, None]) for cells, z in zip(dense, zeros)]
        a, b = full[0][:, None, :], full[1][None, :, :]
        assert (divergence.pair_values(*trees, *zeros, int(width), False, side) == ((a - b) ** 2 // (a + b)).sum(axis=2)).all()
        if trees[0] is not None:
            a, b = full[0][:, None, :], full[0][None, :, :]
            want = np.triu(((a - b) ** 2 // (a + b)).sum(axis=2), 1)
            got = divergence.pair_values(trees[0], trees[0], zeros[0], zeros[0], int(width), True, side)
            assert (np.triu(got, 1) == want).all()
