"""The operators against brute force, exact round trips and held-out accuracy, on small tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

from standout.llm import catalog, common, components, fingerprints, language, mixing, near_copies, neighbours, packing, pii, scoring, simhash, substrings, warc

catalog.load()
SF = "/root/testdata/sf0.001"
WORDS = [a + b for a in "b c d f g k l m n p r s t".split() for b in "a e i o u ar en il os um".split()]


def sentence(rng, n):
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n))


def documents(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, name):
    out = compare(spark, connect(SF), SF, name, catalog.QUERIES[name], catalog.ORACLES[name])
    assert out.startswith("ok"), out


def test_common_helpers(spark):
    rows = spark.range(5000).withColumn("g", F.col("id") % 2)
    some = common.bounded_sample(rows, "id", 10, "g").collect()
    assert Counter(r["g"] for r in some) == {0: 10, 1: 10}
    assert common.bounded_sample(rows, "id", 7).count() == 7
    assert rows.select(common.remainder("id", 7).alias("r")).limit(3).collect()[2]["r"] == zlib.crc32(b"2") % 7


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 130)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_components(bits):
    root = list(range(len(bits)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(bits)), 2):
        if ((bits[i] ^ bits[j]) & (1 << 64) - 1).bit_count() <= 2:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(bits))]


@pytest.mark.parametrize("pairwise", [1, 64])
def test_links_of_fingerprints(spark, pairwise):
    rng = random.Random(3)
    bits = []
    for _ in range(12):
        x = rng.getrandbits(64)
        bits += [x] + [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(25)]
    bits = sorted({b - (1 << 64) if b >> 63 else b for b in bits})
    edges = simhash.near_pairs(spark.createDataFrame([(b,) for b in bits], "bits long"), pairwise=pairwise)
    got = dict(map(tuple, components.components(edges).collect()))
    place = {b: i for i, b in enumerate(bits)}
    assert [place[got.get(b, b)] for b in bits] == brute_components(bits)
    if pairwise == 64:
        wanted = {(a, b) for a, b in itertools.combinations(bits, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
        assert {tuple(r) for r in edges.collect()} == wanted


def test_near_copies_are_those_of_brute_force(spark):
    """One document of each component of texts with five-word shingles of a Jaccard similarity from 0.8 to 1."""
    rng = random.Random(12)
    texts = []
    for n, copies in ((3, 2), (40, 6), (120, 12), (400, 40), (120, 12), (2500, 4)):
        words = sentence(rng, n).split()
        for _ in range(copies):
            own = list(words)
            for _ in range(rng.randint(0, max(1, n // 30))):
                own[rng.randrange(len(own))] = sentence(rng, 1)
            texts.append(" ".join(own).upper() if rng.random() < 0.3 else " ".join(own))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    root = list(range(len(texts)))
    found = 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
            found += sets[i] != sets[j]
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = [new if r == old else r for r in root]
    assert found > 50 and 8 < len(set(root)) < len(texts)
    got = {r["doc_id"] for r in simhash.one_of_each(documents(spark, texts)).collect()}
    assert got == set(root)


def test_one_large_family_of_variants(spark):
    """Five hundred variants of a text, of which brute force links some to the original, some to others and some to none."""
    rng = random.Random(21)
    words, texts = sentence(rng, 200).split(), []
    for k in range(500):
        own = list(words)
        for at in rng.sample(range(200), rng.randint(0, 8)):
            own[at] = f"w{k}x{at}"
        texts.append(" ".join(own))
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for t in texts)]
    root = list(range(500))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(500), 2):
        if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    want = {find(i) for i in range(500)}
    assert 20 < len(want) < 400
    assert {r["doc_id"] for r in simhash.one_of_each(documents(spark, texts)).collect()} == want


def test_variants_that_are_apart_are_not_all_compared(spark, monkeypatch):
    """Variants too far from the original are paired only where they share changed shingles."""
    rng = random.Random(5)
    words, texts, compared = sentence(rng, 200).split(), [], []
    for _ in range(300):
        own = list(words)
        for at in rng.sample(range(200), 7):
            own[at] = f"w{rng.randrange(20)}"
        texts.append(" ".join(own))
    alike = near_copies.alike
    monkeypatch.setattr(near_copies, "alike", lambda pairs, sets: compared.append(pairs.count()) or alike(pairs, sets))
    left = simhash.one_of_each(documents(spark, texts + [" ".join(words)])).count()
    assert left > 200 and sum(compared) < 10 * len(texts)


def test_near_copies_come_from_fingerprints_first(spark):
    rows = [(1, 0b1011), (2, 0b1011), (3, 0b1000), (4, 0b0111 << 20)]
    pairs = near_copies.by_fingerprint(spark.createDataFrame(rows, "shape long, bits long"), simhash.near_pairs)
    assert {frozenset(p) for p in pairs.collect()} == {frozenset((1, 2)), frozenset((1, 3))}
    texts = [sentence(random.Random(1), 30), sentence(random.Random(2), 3), "one"]
    for text in texts:
        found = near_copies.shingle_set(text)
        bits = [sum(int(x) >> i & 1 for x in found) * 2 > len(found) for i in range(64)]
        assert common.fingerprint(found) == sum(b << i for i, b in enumerate(bits))


def test_texts_of_equal_crc_and_clashing_columns(spark):
    assert zlib.crc32(b"plumless") == zlib.crc32(b"buckeroo")
    schema = "doc_id long, text string, mark string, shape long, id int, text_mark string, row int, _mark string"
    rows = [(None, t, "m", 1, 2, "t", 3, "u") for t in ("plumless", "buckeroo", "plumless")]
    out = simhash.one_of_each(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(rows[:2], key=str)


def test_chain_budgets():
    assert simhash.chain_budgets(2, 7) == [0, 0, 0, 1, 1, 1, 2]
    masks = simhash.segment_masks()
    assert sum(masks) == (1 << 64) - 1 and all(9 <= m.bit_count() <= 10 for m in masks)


def test_compact_windows_are_the_tree_of_minima():
    rng = np.random.default_rng(5)
    for n, least in ((0, 3), (2, 3), (3, 3), (60, 7), (200, 20), (64, 1)):
        ranks = rng.integers(0, 1 << 63, n).astype(np.uint64)
        if n > 30:
            ranks[::5] = ranks[3]
        keys = [(int(r) >> 32, i) for i, r in enumerate(ranks)]
        want = []
        for c in range(n):
            low = max((i + 1 for i in range(c) if keys[i] < keys[c]), default=0)
            high = min((i - 1 for i in range(c + 1, n) if keys[i] < keys[c]), default=n - 1)
            if high - low + 1 >= least:
                want.append((c, low, high))
        assert substrings.compact_windows(ranks, least) == want


@pytest.mark.parametrize("words, changes", [(50, 1), (60, 1), (80, 1), (110, 2)])
def test_changed_words_do_not_hide_a_passage(words, changes):
    """Passages with changed words at any place are verified if their whole lengths have a similarity of 0.8 or more."""
    rng = random.Random(words)
    alike = found = 0
    for trial in range(150):
        one = [f"p{trial}x{i}" for i in range(words)]
        two = list(one)
        for at in rng.sample(range(words), changes):
            two[at] = f"q{trial}x{at}"
        left, right = ({tuple(t[i : i + 5]) for i in range(words - 4)} for t in (one, two))
        if len(left & right) / len(left | right) < 0.8:
            continue
        alike += 1
        around = [[f"{side}{k}n{trial}x{i}" for i in range(20)] for side in "ab" for k in range(2)]
        a, b = (" ".join([*around[2 * k], *text, *around[2 * k + 1]]) for k, text in enumerate((one, two)))
        spans = list(substrings.verify(a, b))
        found += any(s[0] < 20 + words and s[0] + s[1] > 20 and s[4] >= 0.8 and min(s[1], s[3]) >= 50 for s in spans)
    assert alike > 20 and found >= 0.95 * alike


def test_repeated_passages(spark):
    rng = random.Random(8)
    passage, other = sentence(rng, 70), sentence(rng, 55)
    edit = passage.split()
    edit[35] = "changed"
    texts = [
        sentence(rng, 40) + " " + passage + " " + sentence(rng, 60),
        sentence(rng, 120) + "\n" + passage.upper() + " " + sentence(rng, 10) + " " + other,
        passage,
        sentence(rng, 300),
        " ".join(edit),
        other + " " + sentence(rng, 200),
        sentence(rng, 49),
        " ".join(passage.split()[:40]) + " " + sentence(rng, 90),
    ]
    got = substrings.repeated_passages(documents(spark, texts)).collect()
    linked = {(r["doc_id"], r["match_doc_id"]) for r in got}
    assert {d for p in linked for d in p} == {0, 1, 2, 4, 5} and (5, 1) in linked and (1, 0) in linked
    for r in got:
        assert r["similarity"] >= 0.8 and r["n_words"] >= 50
        if (r["doc_id"], r["match_doc_id"]) == (1, 0):
            words = texts[1].lower().split()[r["start_word"] : r["start_word"] + r["n_words"]]
            assert words == passage.split() and r["similarity"] == 1.0


def test_common_passage_in_many_contexts(spark):
    """More contexts than are paired: each document is still linked."""
    rng = random.Random(4)
    passage = sentence(rng, 80)
    texts = [f"{sentence(rng, 30)} {passage} {sentence(rng, 30)}" for _ in range(substrings.CONTEXTS + 30)]
    got = substrings.repeated_passages(documents(spark, texts)).collect()
    assert {r["doc_id"] for r in got} | {r["match_doc_id"] for r in got} == set(range(len(texts)))
    assert len(got) < 20 * len(texts)


@pytest.mark.parametrize("words, changes, documents_", [(55, 1, 80), (80, 2, 60)])
def test_templates_in_many_contexts(spark, monkeypatch, words, changes, documents_):
    """A template with changed words has many contexts that differ on both sides of a minimum: as many links as if all were paired."""
    rng = random.Random(words)
    template, texts = sentence(rng, words).split(), []
    for k in range(documents_):
        own = list(template)
        for at in rng.sample(range(words), changes):
            own[at] = f"w{k}x{at}"
        texts.append(" ".join(own))
    got = {(r["doc_id"], r["match_doc_id"]) for r in substrings.repeated_passages(documents(spark, texts)).collect()}
    monkeypatch.setattr(substrings, "CONTEXTS", 10**6)
    want = {(r["doc_id"], r["match_doc_id"]) for r in substrings.repeated_passages(documents(spark, texts)).collect()}
    assert len(want) > 3 * len(texts) and len(want - got) <= len(want) // 100  # a slack place may tip a passage at the threshold


def test_contexts_are_compared_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    passage = sentence(rng, 60)
    docs = documents(spark, [f"{sentence(rng, 30)} {passage} {sentence(rng, 30)}" for _ in range(30)] + [sentence(rng, 90)])
    lots = substrings.windows(docs).select("value", "doc_id", "at", "low", "high")
    whole = sorted(map(tuple, substrings.alike_contexts(lots, docs).collect()))
    assert len({(a[0], b[0]) for _, a, b in whole}) == 30 * 29 // 2
    monkeypatch.setattr(substrings, "BLOCK", 7)
    assert sorted(map(tuple, substrings.alike_contexts(lots, docs).collect())) == whole


def test_samples_estimate_generalised_jaccard():
    rng = random.Random(2)
    near, exact = [], []
    for _ in range(60):
        words = sentence(rng, 200).split()
        a, b = Counter(words), Counter(rng.choices(words, k=150))
        x, y = fingerprints.signatures([a, b], 256)
        near.append(fingerprints.likeness(x, y))
        exact.append(sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(near) - np.mean(exact)) < 0.01
    assert np.abs(np.array(near) - exact).max() < 0.15
    whole = fingerprints.signatures([Counter("abcd"), Counter("abcd"), Counter()])
    assert (whole[0] == whole[1]).all() and not whole[2].any()


def test_next_documents_and_edits(spark):
    rng = random.Random(6)
    texts = [sentence(rng, rng.randint(0, 60)) for _ in range(50)] + ["", "é" * 7]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(documents(spark, texts)).collect()}
    order = list(range(len(texts)))[::-1]
    for here, after in zip(order, order[1:] + order[:1]):
        text, n = texts[here], len(texts[here])
        new = text[: n - n // 2] + texts[after][: n // 2]
        assert got[here]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and got[here]["n_chars"] == n
        signs = fingerprints.signatures([fingerprints.bag(x) for x in (text, new, texts[after])])
        assert got[here]["fingerprint"] == signs[0].astype(">u4").tobytes().hex()
        assert got[here]["near_edited"] == pytest.approx(float((signs[0] == signs[1]).mean()))
        assert got[here]["near_next"] == pytest.approx(float((signs[0] == signs[2]).mean()))


def test_damaged_archives():
    good = [warc.record(i, f"http://x/{i}", b"payload " * 50) for i in range(3)]
    dictionary = warc.train([warc.record(i, f"u{i}", sentence(random.Random(i), 300).encode()) for i in range(600)])
    head = warc.dictionary_frame(dictionary)
    pack = warc.zstandard.ZstdCompressor(dict_data=dictionary, write_checksum=True)
    whole = head + b"".join(pack.compress(r) for r in good)
    assert head and [r["page_id"] for r in warc._records("f", whole)] == [0, 1, 2]
    cut = list(warc._records("f", whole[:-9]))
    assert [r.get("error") is None for r in cut] == [True, True, False]
    wrong = head + pack.compress(good[0].replace(b"Content-Length: ", b"Content-Length: 9", 1)) + pack.compress(good[1])
    assert [r.get("error") is None for r in warc._records("f", wrong)] == [False, True]
    assert "error" in next(warc._records("f", head[:50]))
    assert warc.page_of(warc.record_id(-5, None, "")) == -5 and warc.page_of(warc.record_id(None, "u", "d")) is None


def test_targets_stop_and_are_shared_again(spark):
    sizes = {"a": 10, "b": 1000, "c": 5000, "d": 100, None: 7}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    left, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in sizes if s not in capped]
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            capped[s] = 3 * sizes[s]
            left -= capped[s]
    for s, t in {**share, **capped}.items():
        assert got[s] == pytest.approx(t)


def test_positions_follow_the_schedule(spark):
    texts = [" ".join(["w"] * (1 + i % 7)) for i in range(900)]
    rows = mixing.mixed(documents(spark, texts)).collect()
    assert [r["mix_position"] for r in rows] == sorted(r["mix_position"] for r in rows)
    early, whole = Counter(), Counter()
    for r in rows:
        whole[r["source"]] += len(r["text"].split())
        early[r["source"]] += len(r["text"].split()) * (r["mix_position"] < 0.5)
    assert early["s0"] / whole["s0"] == pytest.approx(0.6, abs=0.03)
    assert early["s1"] / whole["s1"] == pytest.approx(0.5, abs=0.03)
    assert early["s2"] / whole["s2"] == pytest.approx(0.375, abs=0.03)
    assert mixing.integral(mixing.SCHEDULES[0]) == 5


def test_recall_of_the_index(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(3000, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    got = neighbours.search(rows, F.col("vec_id") % 50 == 0).collect()
    data = data.astype(np.float32).astype(np.float64)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        scores = unit @ unit[q]
        scores[q] = -2
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(r["score"] == pytest.approx(scores[r["vec_id"]], abs=1e-12) for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(np.argsort(-scores)[:5].tolist()))
    assert hits / 300 >= 0.9


def test_copies_of_a_vector(spark):
    """One vector fills several blocks; ties go to the smaller id."""
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(9000)] + [(9000 + i, [float(i), 1.0, -1.0, 0.5]) for i in range(200)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.search(vectors, F.col("vec_id").isin(0, 50)).collect()
    found = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 50)}
    assert found == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4]}


def test_ids_are_those_of_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing.CachedTokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(1)
    signs = [" ", "  ", "\n", "\t", " \n", " ", " ", "a", "B", "é", "1", "23", "'s", "'", "!", "...", "日本", "😀", "_", "\x1c", "don't"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [sentence(rng, 500)]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, own.kind).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1]


def test_added_tokens_have_their_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing.CachedTokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(2)
    signs = [" ", "  ", "\n", "a", "word", "é", "<|endoftext|>", "<|endoftext|>", "<|endoftext", "|>", "<", "don't", "日本"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(2000)] + ["a <|endoftext|> b"]
    got = [np.frombuffer(ids, own.kind).tolist() for ids in own.encode(texts)]
    assert got == [[*plain.encode(text, add_special_tokens=False).ids, 1] for text in texts]
    assert got[-1] == [64, 220, 50256, 275, 1]


def test_packing_is_whole_and_keeps_proportions(spark):
    rng = random.Random(9)
    texts = [sentence(rng, rng.choice([0, 3, 80, 400, 3000])) for _ in range(300)]
    docs = documents(spark, texts)
    pieces = packing.pack(docs, with_ids=True).collect()
    by, sequences = {}, {}
    for r in pieces:
        by.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    import public_tokenizers

    own = packing.CachedTokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for i, ids in enumerate(own.encode(texts)):
        whole = np.frombuffer(ids, own.kind).astype("<u4")
        parts = sorted(by[i], key=lambda r: r["start"])
        assert b"".join(r["ids"] for r in parts) == whole.tobytes() and {r["doc_tokens"] for r in parts} == {len(whole)}
        assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] == len(r["ids"]) // 4 for r in parts)
    for parts in sequences.values():
        parts.sort(key=lambda r: r["offset"])
        ends = list(itertools.accumulate(r["length"] for r in parts))
        assert [r["offset"] for r in parts] == [0, *ends[:-1]] and ends[-1] <= 2048 and ends[-1].bit_count() == 1


def test_round_robin_fills_windows_to_the_shares():
    robin = packing.RoundRobin(2048, 64)
    for source, share in (("a", 0.6), ("b", 0.3), ("c", 0.1)):
        robin.add_source(source, share, 0.0)
        for k in range(300):
            robin.add(source, k, np.zeros(int(1000 * share) + k % 50, np.uint16))
    used = Counter()
    for window in itertools.islice(robin.sequences(20_000), 60):
        share = Counter()
        for _, _, ids, whole, _ in window:
            share[whole] += len(ids)
        used.update(share)
        assert sum(share.values()) == 2048
    of = {s: sum(n for size, n in used.items() if low <= size < low + 50) for s, low in (("a", 600), ("b", 300), ("c", 100))}
    total = sum(used.values())
    assert [round(of[s] / total, 2) for s in "abc"] == [0.6, 0.3, 0.1]


def test_base_scores_and_model(spark):
    rng = random.Random(12)
    texts = [sentence(rng, rng.randint(0, 120)) for _ in range(150)]
    rows = {r["doc_id"]: r for r in scoring.score(documents(spark, texts), head_words=40).collect()}
    words = {i: [*t.encode().lower().split(), None] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in words}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in words.items():
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    own = sum(rows[i]["score"] for i in words if held[i])
    size = sum(len(w or b"") + 1 for i, ws in words.items() if held[i] for w in ws)
    assert -own * math.log2(10) / size < 4.0


def test_model_is_a_distribution():
    """All words of one byte, with the end, have less than all probability; the decisions at one place have all of it."""
    code = scoring.Code(np.bincount(np.frombuffer(b"bcdbc a", np.uint8), minlength=256).astype(float))
    assert sum(2.0 ** -int(n) for n in code.sizes) == 1.0
    tables = scoring.count_bits(code, iter([([b"a bc", b"a bd", b"c d"], np.array([3, 2, 1], np.float32))]))
    model = scoring.Model(tables, code, scoring.Mixer())
    keys = [b"a " + bytes([b]) for b in range(1, 256) if bytes([b]).split() == [bytes([b])]]
    assert 0 < sum(10 ** model.logs(keys)) + 10 ** model.logs([b"a "])[0] < 1
    parts = {}
    for key in keys:
        part = next(scoring.decisions([key], code))
        for n in range(int(code.sizes[key[2]])):
            parts.setdefault(int(part.node[n]), []).append(int(part.bit[n]))
    assert all(set(b) <= {0, 1} for b in parts.values()) and len(parts) > 240


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def test_base_spans_are_the_patterns():
    rng = random.Random(7)
    pieces = ["a", "b.c", "@", "@@", "x-1", "%", " ", "  ", "-", ".", "1", "22", "255", "256", "+", "+4", "(", ")", "\n", "é", "4111 1111 1111 1111", "1.2.3.4", "+49 30 123456", "ab@cd.ef"]

    def fine(kind, text):
        digits = re.sub("[^0-9]", "", text)
        if kind == "ip":
            return all(int(p) <= 255 for p in text.split("."))
        if kind == "card":
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
            return 12 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        want = [(*m.span(), k) for k, p in PATTERNS.items() for m in re.finditer(p, text) if fine(k, m.group())]
        assert pii.base_spans(text) == sorted(want, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_tagger_finds_spans_by_itself(monkeypatch):
    rng = random.Random(5)

    def text():
        kind = rng.choice(["", "email", "phone"])
        made = {"": "", "email": f"{rng.choice(WORDS)}.{rng.choice(WORDS)}@{rng.choice(WORDS)}.org", "phone": f"+49 30 {rng.randint(10**6, 10**7)}"}
        return f"{sentence(rng, 12)} {rng.randint(0, 99)} {made[kind]} {sentence(rng, 30)}"

    draw = np.random.default_rng(0)
    windows = [w for _ in range(300) for w in pii._labelled(text(), draw)]
    net = pii.train(np.array([x for x, _ in windows]), np.array([y for _, y in windows]))
    texts = [text() for _ in range(80)]
    base = [pii.base_spans(t) for t in texts]
    monkeypatch.setattr(pii, "base_spans", lambda _: [])
    found = [[s for s, _ in row] for row in pii.find(texts, net)]
    hits = sum(len(set(a) & set(b)) for a, b in zip(base, found))
    assert hits / sum(map(len, base)) > 0.9 and hits / max(1, sum(map(len, found))) > 0.9


@pytest.mark.parametrize("doc_id", [None, 7])
def test_bounded_sample_where_ids_are_missing_or_equal(spark, doc_id):
    rows = [(doc_id, f"text {i}", "ab"[i % 2]) for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert common.bounded_sample(docs, ["doc_id", "text"], 100).count() == 100
    sizes = common.bounded_sample(docs, ["doc_id", "text"], 50, "lang").groupBy("lang").count().collect()
    assert sorted(tuple(r) for r in sizes) == [("a", 50), ("b", 50)]


def test_held_out_language(spark):
    rng = random.Random(3)
    stock = {"aa": "the of and ing tion er".split(), "bb": "der die und ung keit sch".split(), "cc": "los que ción ado mente as".split()}
    rows = []
    for i in range(240):
        name = rng.choice(list(stock))
        rows.append((i, " ".join("".join(rng.choice(stock[name]) for _ in range(rng.randint(1, 3))) for _ in range(40)), name))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(docs).collect()
    held = [r for r in got if r["held_out"]]
    assert held and {r["doc_id"] for r in held} == {i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == rows[r["doc_id"]][2] for r in held) / len(held) >= 0.95
