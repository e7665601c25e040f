"""The manifest against a plain tree, on real and odd tables."""

import hashlib
import zlib

import duckdb
import pytest

from cladewright.llm import merkle, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, source string, lang string, n_chars long, text string, pos int, n int, leaf int, grp int, path string, height int"
ODD = [
    (1, "a", "en", 3, "x\ny"), (1, "a", "en", 3, "x\ny"), (2, "a", None, None, None), (4, None, "en", 0, ""), (None, "a", None, None, "no\nid"), (None, "a", None, None, "no\nid"), (7, "b", "en", 3, "1:-"), (8, "é", "en", 3, "word\n" * 30000),
    (9, "z", "en", 1, "\n"), (None, None, None, None, None), (-3, "a", "é", -1, "é\n"), (11, "", "", 5, "a"),
]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(rows):
    """Rows (doc_id, source, lang, n_chars, text) audited one by one."""
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: digest(*[said(v) for v in (*r[:4], text)])

    def tree(nodes):
        """The root of some digests, and of each its path: (left, right) upwards."""
        paths, own = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            up, who = [], []
            for low in range(0, len(nodes), 3):
                run = nodes[low:low + 3]
                for k in range(len(run)):
                    for i in own[low + k]:
                        paths[i].append(("".join(run[:k]), "".join(run[k + 1:])))
                up.append(digest(*run))
                who.append(sum(own[low:low + 3], []))
            nodes, own = up, who
        return nodes[0] if nodes else None, paths

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    found, subroots = [], []
    for s in sources:
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        top, paths = tree([leaf(r, r[4]) for r in mine])
        subroots.append(top)
        found.append((mine, paths))
    root, over = tree(subroots)
    out = []
    for s, (mine, paths), sub in zip(range(len(sources)), found, subroots, strict=True):
        for r, path in zip(mine, paths, strict=True):
            whole = path + over[s]
            text = r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
            now = leaf(r, text)
            for left, right in whole:
                now = digest(left, now, right)
            out.append((r[0], leaf(r, r[4]), sub, root, digest(*[x for p in whole for x in p]), now, now == root))
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_manifest_equals_a_plain_tree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()])
    assert rows(queries.op13_merkle_manifest(spark, SF)) == want
    assert any(r[6] for r in want) and not all(r[6] for r in want)


@pytest.mark.parametrize("some", [ODD, ODD[:1], ODD[:2], ODD[2:4], []])
def test_odd_tables(spark, some):
    got = merkle.audited(spark.createDataFrame([(*r, 1, 1, 1, 1, "p", 1) for r in some], DOCS))
    assert rows(got) == plain(some)


def test_many_sources_of_all_sizes(spark):
    some = [(i, f"s{n}", None, n, "t") for n in range(1, 32) for i in range(n)]
    docs = spark.createDataFrame(some, "doc_id long, source string, lang string, n_chars long, text string")
    assert rows(merkle.audited(docs.repartition(5))) == plain(some)


def test_sql_equals_query(spark):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = db.execute(f"select doc_id, leaf, subroot, root, proof_sha256, folded_root, verified from ({queries.ORACLES['op13_merkle_manifest']})").fetchall()
    assert rows(queries.op13_merkle_manifest(spark, SF)) == sorted(want, key=repr)
