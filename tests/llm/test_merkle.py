"""The Merkle manifest against a plain tree over all rows at once."""

import hashlib
import zlib

from pyspark.sql import functions as F

from tagloom.llm import merkle
from tagloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(leaves):
    """(root, each leaf's witness) by whole levels of runs of 16."""
    paths, nodes = [[] for _ in leaves], [(x, [k]) for k, x in enumerate(leaves)]
    while len(nodes) > 1:
        above = []
        for a in range(0, len(nodes), 16):
            run = nodes[a : a + 16]
            for j, (_, members) in enumerate(run):
                for k in members:
                    paths[k].append(("".join(x for x, _ in run[:j]), "".join(x for x, _ in run[j + 1 :])))
            above.append((sha("".join(x for x, _ in run)), [k for _, members in run for k in members]))
        nodes = above
    return nodes[0][0], paths


def plain_manifest(rows):
    """rows (doc_id, source, lang, n_chars, text)."""
    lower = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    leaf = lambda r, t: sha("".join(map(told, (*r[:4], t))))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r, leaf(r, r[4])))
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = []
    for k in keys:
        groups[k].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees.append(plain_tree([x for _, x in groups[k]]))
    root, tops = plain_tree([s for s, _ in trees])
    out = []
    for k, (subroot, paths), top in zip(keys, trees, tops, strict=True):
        for (r, own), path in zip(groups[k], paths, strict=True):
            given = leaf(r, lower(r[4])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else own
            for before, after in path + top:
                given = sha(before + given + after)
            out.append((r[0], own, subroot, root, sha("".join(b + e for b, e in path + top)), given, given == root))
    return sorted(out, key=str)


def run_on(spark, rows, tmp_path):
    spark.createDataFrame([(*r, "k", 5) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, g string, rank long").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(x[c] for c in COLUMNS) for x in QUERIES["op12_merkle_manifest"](spark, str(tmp_path)).collect()), key=str)


def test_manifest_of_documents(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted((tuple(x[c] for c in COLUMNS) for x in QUERIES["op12_merkle_manifest"](spark, SF).collect()), key=str)
    assert got == plain_manifest(rows) and any(not x[-1] for x in got)


def test_manifest_of_odd_rows(spark, tmp_path):
    rows = [(k, s, "en", k, t) for k, (s, t) in enumerate([(None, None), ("", ""), ("a", "ABC"), ("é", "ÉA"), ("z", "-"), ("z", "x" * 200_000), ("Z", "a\x00B"), ("z", "A")] * 6)]
    rows += [(None, "z", None, None, None), (None, "z", None, None, "b"), (10, "z", "en", 3, "ABC"), (10, "z", "en", 3, "ABC"), (-5, "z", "en", 3, "ABC"), (10, None, "en", 3, "ABC")]
    assert run_on(spark, rows, tmp_path) == plain_manifest(rows)


def test_manifest_of_no_and_of_one_row(spark, tmp_path):
    (tmp_path / "a").mkdir()
    assert run_on(spark, [], tmp_path / "a") == []
    (tmp_path / "b").mkdir()
    got = run_on(spark, [(7, "s", "en", 1, "x")], tmp_path / "b")
    assert got == plain_manifest([(7, "s", "en", 1, "x")]) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha("")


def test_manifest_of_a_hot_source_and_of_many_sources(spark, tmp_path):
    """More leaves than a block in one source, and more sources than a block."""
    rows = [(k, "hot", "en", k, f"Text {k}") for k in range(4096 + 4096 + 17)] + [(k, f"s{k}", "en", k, None) for k in range(4100)]
    assert run_on(spark, rows, tmp_path) == plain_manifest(rows)


def test_open_tree_equals_the_plain_tree():
    for n in (1, 2, 15, 16, 17, 255, 256, 257, 272, 4096, 4097):
        leaves, tree = [sha(str(k)) for k in range(n)], merkle.OpenTree()
        for x in leaves:
            tree.append(x)
        root = tree.finish()
        assert (root, tree.paths) == plain_tree(leaves)
        assert all(merkle.fold(x, p) == root for x, p in zip(leaves, tree.paths, strict=True))


def test_row_digest(spark):
    row = spark.createDataFrame([(1, None, "é")], "a long, b string, c string").select(merkle.row_digest(F.col("a"), F.col("b"), F.col("c"))).first()[0]
    assert row == sha("1:1-2:é")
