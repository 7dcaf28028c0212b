"""Merkle manifests, spelling variants and toxicity against plain versions, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF, same_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("of", "at", "node", "other", "id", "word", "n", "key", "label", "bucket", "root", "total", "block", "part")


@pytest.fixture(scope="module")
def empty(spark):
    from tidemark.llm.shared import ship

    ship(spark)
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", ["op11_manifest", "op12_spelling"])
def test_sql(spark, duck, name):
    from tidemark.llm import queries

    same_rows(queries.queries()[name](spark, SF).toPandas(), duck.sql(queries.SQL[name]).df())


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded) of (doc_id, text, lang, source, n_chars), a level at a time."""

    def leaf(doc_id, text, lang, source, n_chars):
        return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
        return out

    def beside(tree, at):
        out = []
        for level in tree[:-1]:
            run = level[at // 2 * 2 : at // 2 * 2 + 2]
            out.append((run[:0], run[1:]) if at % 2 == 0 else (run[:1], run[2:]))
            at //= 2
        return out

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: levels([x[2] for x in sorted(groups[k], key=lambda x: x[:3])]) for k in names}
    top = levels([trees[k][-1][0] for k in names]) if names else []
    out = []
    for g, k in enumerate(names):
        for at, (_, _, h, r) in enumerate(sorted(groups[k], key=lambda x: x[:3])):
            way = beside(trees[k], at) + beside(top, g)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            now = leaf(*r[:4], r[4] + 1) if hit else h
            for left, right in way:
                now = H(*left, now, *right)
            out.append((r[0], h, trees[k][-1][0], top[-1][0], H(*(x for pair in way for side in pair for x in side)), now, now == top[-1][0]))
    return out


def test_manifest(spark, empty):
    from tidemark.llm.merkle import BITS, Subtree, Version, build, climbed, document_manifest, joined, verified

    rng = random.Random(3)
    odd = [(1, None, None, None, None), (2, "", "", "", 0), (None, "x", "en", "s", 1), (None, "x", "en", "s", 1), (None, None, None, None, 5), (7, "a", "en", "s", 2**63 - 1), (7, "a", "en", "s", 2**63 - 1), (7, "b", "en", "s", 1), (8, "é𝒳" * 50_000, "日本", "ß", 3)]
    many = [(i, f"t{i}", rng.choice(["en", "en", "en", "de", "fr"]), "s", None if i % 11 == 0 else i) for i in rng.sample(range(10_000), 1500)]
    lone = [(i, "t", f"l{i:03d}", None, 1) for i in range(300)]  # more groups than a block has leaves
    for rows in (odd, odd + many, lone):
        got = document_manifest(spark.createDataFrame(rows, DOCS).repartition(5).withColumns({c: F.lit("clash") for c in CLASH})).collect()
        assert collections.Counter(map(tuple, got)) == collections.Counter(plain_manifest(rows))
    assert document_manifest(empty).count() == 0
    # more than two tiers, with every leaf changed to the same: versions stay apart and share nodes
    import tidemark.llm.merkle as merkle

    merkle.BITS, bits = 2, BITS
    try:
        rows = [(i, "t", "en", "s", 1) for i in range(150)]
        found = verified(build(spark.createDataFrame(rows, DOCS), F.lit(True), changes={"text": F.lit("u")})).collect()
    finally:
        merkle.BITS = bits
    leaves = [H(f"{len(str(i))}:{i}", "1:s", "2:en", "1:1", "1:t") for i in range(150)]
    tree = Subtree.over(leaves)
    for r in found:
        wanted = climbed(H(f"{len(str(r.id))}:{r.id}", "1:s", "2:en", "1:1", "1:u"), tree.siblings(r.id))
        assert r.leaf == leaves[r.id] and r.root == tree.root and list(r.copied) == wanted and r.folded_root == wanted[-1] and not r.verified
    version = Version.of(tree, 9, "other")
    changed = Subtree.over([*leaves[:9], "other", *leaves[10:]])
    assert all(version.node(d, i) == h for d, level in enumerate(changed.levels) for i, h in enumerate(level))
    assert joined("a", "b") == H("ab")


def plain_variants(rows):
    """{word: (n, n_near, form, form_n, root)} by comparing with all words one edit away."""
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            n[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    letters = sorted({c for w in words for c in w})
    out = {}
    for w, c in words.items():
        near = {w[:i] + x + w[i + k :] for i in range(len(w) + 1) for k in (0, 1) for x in ["", *letters] if i + k <= len(w)} - {w}
        near = sorted((-words[x], x) for x in near if x in words)
        form = near[0][1] if near and -near[0][0] >= 10 * c else None
        out[w] = [c, len(near), form, words.get(form)]
    for w, v in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        v.append(root)
    return {w: tuple(v) for w, v in out.items()}


def test_spelling(spark, empty):
    from tidemark.llm.spelling import STRIP, pivots, prefixes, runs, variants

    rng = random.Random(8)
    stems = ["".join(rng.choice("abcdéÿ×") for _ in range(rng.randint(5, 12))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "abababab", "x" * 70, "x" * 71]

    def spoilt(w):
        i, k = rng.randint(0, len(w)), rng.randint(0, 2)
        return w[:i] + ("" if k == 0 else rng.choice("abcdéÿ×")) + w[i + (k != 2) :]

    words = [w for s in stems for w in [s] * rng.choice([1, 40, 400]) + [spoilt(s) for _ in range(25)] + [spoilt(spoilt(s)) for _ in range(25)]] + ["dbcabca"] * 3 + ["dbcabcab"] * 60 + ["dbcabcabd"] * 1500
    rng.shuffle(words)
    rows = [(i % 97 if i % 5 else None, rng.choice([" ", ". ", "—", "’", "1"]).join(x.upper() if rng.random() < 0.1 and x.isascii() else x for x in words[i * 40 : i * 40 + 40])) for i in range(len(words) // 40)]
    rows += [rows[3], (4, None), (5, ""), (6, "!!"), (7, "word " * 40_000), (8, "a" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = variants(docs.withColumns({c: F.lit("clash") for c in CLASH})).collect()
    wanted = plain_variants(rows)
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == wanted and len(got) == len(wanted)
    assert sum(v[2] is not None for v in wanted.values()) > 20 and sum(v[2] is not None and v[4] != v[2] for v in wanted.values()) > 0
    assert variants(empty).count() == 0
    long = "ab cd" * (STRIP // 3)
    assert list(runs(long)) == [w.encode() for w in long.split()]
    # pivots are the cheapest disjoint two of the prefix
    letters = np.frombuffer(b"".join("".join(rng.choice("abcd") for _ in range(9)).encode() for _ in range(300)), np.uint8).reshape(-1, 9)
    number = np.random.default_rng(0).integers(1, 50, 1 << 16)
    rank = np.empty(1 << 16, np.int64)
    rank[np.lexsort((np.arange(1 << 16), number))] = np.arange(1 << 16)
    prefix = prefixes(letters, rank)
    for row, own, a, b in zip(letters, prefix, *pivots(letters, prefix, number), strict=True):
        cost = [int(number[int(row[i]) << 8 | int(row[i + 1])]) for i in range(8)]
        assert own[a] and own[b] and b - a >= 2
        assert cost[a] + cost[b] == min(cost[i] + cost[j] for i in range(8) for j in range(i + 2, 8) if own[i] and own[j])


def test_toxicity(spark, empty):
    from tidemark.llm.toxicity import STRIP, Settings, document_counts, grams, labelled, ratios, toxicity

    def plain(text, settings):
        words = re.sub(r"[^\W\d_]+", lambda m: f" {m[0]} ", (text or "").lower())
        words = [f" {w} " for w in re.findall(r"[^\W\d_]+", words)]
        return collections.Counter(w[i : i + n] for w in words for n in settings.orders for i in range(len(w) - n + 1))

    settings = Settings()
    rng = random.Random(2)
    texts = ["Some Words, of a text!", "é日本 ß x", "a", "", "1 2 3", "".join(rng.choice("abc é.") for _ in range(2 * STRIP + 77)), "x" * (STRIP + 3)]
    for t in texts:
        found, wanted = [h for part in grams(t, settings) for h in part.tolist()], plain(t, settings)
        assert len(found) == sum(wanted.values())
        assert 0 <= len(wanted) - len(set(found)) <= len(wanted) / 500  # few share a bucket
    mild, rude = ["the small house stands there", "rivers run to the sea", "she reads a long book"], ["you utter blockhead", "such blockheaded rubbish", "a rubbishy numbskull"]
    rows = [(i, " ".join([rng.choice(mild) for _ in range(rng.randint(1, 6))] + ([rng.choice(rude)] if i % 4 == 0 else [])), None, None, 0) for i in range(600)]
    label = [(i, 1, int(i % 4 == 0)) for i in range(500)] + [(3, 1, 0), (12, 0, 0), (777_777, 1, 1), (None, 1, 1)]
    rows += [(None, "you blockhead", None, None, 0), (5001, None, None, None, 0), (5002, "", None, None, 0), (5003, "12 !", None, None, 0), (5004, "blockhead " * 40_000, None, None, 0), rows[8], rows[8]]
    docs = spark.createDataFrame(rows, DOCS).repartition(6).withColumns({c: F.lit("clash") for c in CLASH})
    labels = spark.createDataFrame(label, "doc_id long, quality int, toxic int")
    got = toxicity(docs, labels).collect()
    assert len(got) == len(rows) and collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    known = {r.doc_id: r for r in got}
    assert all(known[i].predicted == (i % 4 == 0) for i in range(600)) and known[None].predicted == 1 and known[5004].predicted == 1
    assert known[5001].score == known[5002].score == known[5003].score < 0.5
    again = {r.doc_id: r.score for r in toxicity(docs.repartition(3), labels).collect()}
    assert all(again[i] == known[i].score for i in again)
    # counts over all labelled rows that aren't held out
    train = [(t, max(x[2] for x in label if x[0] == i)) for i, t, *_ in rows if i is not None and i in {x[0] for x in label} and zlib.crc32(str(i).encode()) % 4 != 2]
    counts = {r.bucket: (r.none, r.some) for r in document_counts(labelled(docs, labels)).collect()}
    assert counts[-1] == (sum(y == 0 for _, y in train), sum(y == 1 for _, y in train))
    wanted = collections.Counter(), collections.Counter()
    for t, y in train:
        wanted[y].update({h for part in grams(t, settings) for h in part.tolist()})
    assert {k: v for k, v in counts.items() if k >= 0} == {k: (wanted[0][k], wanted[1][k]) for k in wanted[0] | wanted[1]}
    assert np.allclose(ratios(np.array([0, 3]), np.array([1, 3]), (10, 4)), [0, np.log((4 / 6) / (4 / 12))])
    # without labels, or with one kind of them
    none, ones = labels.where("false"), labels.where("toxic = 1")
    assert {r.score < 1e-9 for r in toxicity(docs, none).collect()} == {True} and {round(r.score, 6) for r in toxicity(docs, ones).collect()} == {1.0}
    assert toxicity(empty, labels).count() == 0


def test_toxicity_held_out(spark):
    """On the given documents, of which held-out ones have not been learned."""
    from tidemark.llm.queries import op13_toxicity

    sf = SF.replace("0.001", "0.01")
    got = op13_toxicity(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert held.predicted[held.toxic == 1].mean() >= 0.7 and held.predicted[held.toxic == 0].mean() <= 0.03
