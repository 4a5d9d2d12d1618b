"""Manifest, secret scan and ranked search against brute force, their SQL and by hand, on small tables with nulls, long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from leafwork.llm import bpe, lexical_search, merkle, oracles, queries, secret_scan

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _tree string, _idx long, blob string, item int, n long"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), "x", 3, "b", 1, 9) for i, t, lang, src in rows], SCHEMA)


EDGES = [(1, None, "en", "a"), (2, "", None, None), (3, "  \n\t", None, "a"), (None, "Lost", "en", "a"), (4, "Word " * 30000 + "password = hunter2hunter2", "en", "a"), (5, "Ünï ÇØDE 漢字 🙂 token: abcdEFGH12", "", "b"), (5, "Ünï ÇØDE 漢字 🙂 token: abcdEFGH12", "", "b")]


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_tree(leaves, width):
    steps, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, p in enumerate(at):
            b = p // width * width
            steps[i].append(("".join(level[b:p]), "".join(level[p + 1 : b + width])))
            at[i] = p // width
        level = [H("".join(level[k : k + width])) for k in range(0, len(level), width)]
    return level[0], steps


def brute_manifest(rows, width=8):
    def leaf(r, text):
        return H("".join(map(field, (r[0], r[3], r[2], None if r[1] is None else len(r[1]), text))))

    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append(r)
    langs, tops, low = sorted(trees, key=lambda x: (x is not None, (x or "").encode())), [], {}
    for lang in langs:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        top, low[lang] = brute_tree([leaf(r, r[1]) for r in trees[lang]], width)
        tops.append(top)
    root, high = brute_tree(tops, width)
    out = Counter()
    for lang, top, more in zip(langs, tops, high, strict=True):
        for r, own in zip(trees[lang], low[lang], strict=True):
            start = leaf(r, r[1])
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                start = leaf(r, r[1].translate(LOW))
            for before, after in own + more:
                start = H(before + start + after)
            out[r[0], leaf(r, r[1]), top, root, H("".join(a + b for a, b in own + more)), start, start == root] += 1
    return out


@pytest.mark.parametrize(("n", "width"), [(0, 8), (1, 8), (8, 8), (9, 8), (65, 8), (40, 2), (31, 3)])
def test_manifest_is_brute_force(spark, n, width):
    r = random.Random(n)
    rows = [(i, r.choice([None, "", "Some Text", f"text {i}"]), r.choice(["en"] * 4 + [None, "de", "ß", "zz"]), r.choice(["a", None])) for i in r.sample(range(1000), n)]
    got = Counter(map(tuple, merkle.merkle_manifest(table(spark, rows), width).collect()))
    assert got == (brute_manifest(rows, width) if rows else Counter())


def test_manifest_takes_edge_cases(spark):
    rows = EDGES + [(7, "Repeated Row", "xx", "a")] * 20
    got = Counter(map(tuple, merkle.merkle_manifest(table(spark, rows)).collect()))
    assert got == brute_manifest(rows)


def test_manifest_nodes_hash_their_children(spark):
    rows = [(i, f"t{i}", "en" if i % 5 else None, "a") for i in range(100)]
    nodes = {(x.part, x.tree, x.level, x.idx): x.digest for x in merkle.manifest(table(spark, rows), 4).collect()}
    for (part, tree, level, i), d in nodes.items():
        if level:
            assert d == H("".join(nodes[part, tree, level - 1, j] for j in range(4 * i, 4 * i + 4) if (part, tree, level - 1, j) in nodes))
    assert nodes["root", None, 0, 0] == nodes["lang", None, 3, 0]


def test_manifest_numbers_ranges_without_gaps(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("_tree"), (F.col("id") * 7919 % 3000).alias("k"), F.lit("d").alias("_digest"))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = merkle.numbered(rows, "k").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for tree, n in (("a", 1000), ("b", 2000)):
        mine = sorted((x.k, x._idx) for x in got if x._tree == tree)
        assert [i for _, i in mine] == list(range(n)) and all(x._n == n for x in got if x._tree == tree)


KINDS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def brute_secrets(text):
    spans = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(KINDS) for m in p.finditer(text or "") if ok(m))
    return (*(sum(k == j for _, k, _ in spans) for j in range(3)), H(",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in spans)))


def secret_texts(n, seed):
    r = random.Random(seed)
    bits = ["password", "PassWd", "secret", "ſecret", "toKen", "api_key", "APIKEY", "=", ":", " ", "  ", '"', "'", "=", "abcd", "abcdefgh", "0123456789abcdef", "AKIA", "ABCDEFGH", "1234", "é", "🙂", "\n", "x", "deadbeef" * 4, "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "Bearer "]
    return ["".join(r.choices(bits, k=r.randrange(60))) for _ in range(n)]


def test_secret_scan_is_brute_force_and_its_sql(spark, tmp_path):
    texts = secret_texts(300, 1)
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(1000 + i, texts[7], "en", "a") for i in range(40)] + EDGES
    got = secret_scan.secret_scan(table(spark, rows)).collect()
    want = Counter((i, *brute_secrets(t)) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    assert any(f"{k}:" in r.spans for r in got for k in ("pem", "jwt", "bearer"))
    base = {"assign", "access", "hex"}
    assert all(H(",".join(x for x in r.spans.split(",") if x.split(":")[0] in base)) == r.base_sha256 for r in got)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, t, *_ in rows])
    assert Counter(con.execute(oracles.oracle_sql()["op12_secret_scan"]).fetchall()) == Counter(map(tuple, got))
    assert secret_scan.secret_scan(table(spark, [])).collect() == []


def test_secret_rules_span_what_they_name():
    for r in secret_scan.MORE:
        p = re.compile(r.pattern)
        text = {"pem": "-----BEGIN EC PRIVATE KEY-----", "jwt": "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "bearer": "bearer abcdefghijklmnopqrst", "prefixed": "ghp_" + "a1" * 18}[r.kind]
        assert p.search("see " + text + " .")[0] == text
        assert not p.search("a bearer of news, a private key, eyJ.a.b and ghp_short")


def test_ledger_scans_unseen_pairs_alone(spark):
    ledger = secret_scan.Ledger(spark)
    v1 = [(1, "token = abcdefgh1", "en", "a"), (2, "nothing", "en", "a"), (3, "token = abcdefgh1", "en", "a")]
    rows = lambda rs: secret_scan.addressed(table(spark, rs), "doc_id")
    assert ledger.commit(rows(v1).select("blob", "_text")) == 2 * len(secret_scan.RULES)  # two distinct texts
    assert ledger.commit(rows(v1).select("blob", "_text")) == 0
    v2 = [(1, "token = abcdefgh1 changed", "en", "a"), (2, "nothing", "en", "a")]
    assert ledger.commit(rows(v2).select("blob", "_text")) == len(secret_scan.RULES)
    newer = (*secret_scan.RULES, secret_scan.Rule("word", 1, "nothing"))
    assert ledger.commit(rows(v1 + v2).select("blob", "_text"), newer) == 3  # the new rule alone, on three texts
    assert ledger.seen().count() == ledger.seen().distinct().count() == 3 * len(newer)
    assert ledger.findings().count() == ledger.findings().distinct().count() == 3
    # findings of every version join back to all paths that ever had it
    history = rows(v1).withColumn("version", F.lit(1)).union(rows(v2).withColumn("version", F.lit(2))).select("doc_id", "version", "blob")
    found = {(r.doc_id, r.version): [(x.kind, x.start, x.end) for x in r.found] for r in secret_scan.at_paths(history, ledger.findings(), newer).collect()}
    assert found == {(1, 1): [("assign", 0, 17)], (3, 1): [("assign", 0, 17)], (2, 1): [("word", 0, 7)], (1, 2): [("assign", 0, 17)], (2, 2): [("word", 0, 7)]}


def test_ledger_ignores_a_commit_that_broke_off(spark):
    ledger = secret_scan.Ledger(spark)
    docs = secret_scan.addressed(table(spark, [(1, "secret: abcdefgh", "en", "a")]), "doc_id")
    found, _ = secret_scan.scan(docs.select("blob", "_text"))
    found.write.parquet(f"{ledger.path}/findings/lost")
    assert ledger.seen() is None and ledger.findings().count() == 0
    ledger.commit(docs.select("blob", "_text"))
    assert ledger.findings().count() == 1


def test_secret_scan_stays_in_the_engine(spark, tmp_path):
    table(spark, EDGES).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    plan = queries.queries()["op12_secret_scan"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_search(docs, items, k):
    find = lambda t: re.findall(lexical_search.TERM, (t or "").translate(LOW))
    d = [(i, len(x), Counter(x)) for i, x in ((i, find(t)) for i, t in docs) if x]
    n_all, total, df = len(d), sum(x[1] for x in d), Counter(t for _, _, c in d for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(find(text))
    out = []
    for item, terms in wanted.items():
        scores = []
        for i, n, c in d:
            m = 50 + (50 * n * n_all) // total
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, i is not None, i or 0))
        scores.sort()
        out += [(item, r + 1, i if there else None, -s) for r, (s, there, i) in enumerate(scores[:k])]
    return Counter(out)


@pytest.mark.parametrize("postings", [1, 60, 10**9])
def test_search_is_brute_force_and_its_sql(spark, monkeypatch, postings):
    monkeypatch.setattr(lexical_search, "BLOCK_POSTINGS", postings)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        r = random.Random(2)
        vocabulary = [f"w{int(60 ** (i / 59))}" for i in range(60)] + ["Über", "naïve", "漢字", "W1", "a_b", "x-1"]
        text = lambda most: "".join(r.choice(vocabulary) + r.choice([" ", "\n", ", ", "\x00", "—"]) for _ in range(r.randrange(most)))
        docs = [(i, text(40), "en", "a") for i in range(150)] + [(500 + i, "w1 w2 same score", "en", "a") for i in range(30)] + [(600, "same", "en", "a")] * 3 + EDGES
        items = [(i, text(25)) for i in range(12)] + [(50, None), (51, ""), (52, "absent"), (53, "same"), (53, "w1"), (54, "word ünï ÜNÏ")]
        got = lexical_search.lexical_search(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"), k=7).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert Counter(map(tuple, got)) == brute_search([(i, t) for i, t, *_ in docs], items, 7)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, t, *_ in docs])
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    sql = con.execute(oracles.oracle_sql()["op13_lexical_search"].replace("<= 50", "<= 7")).fetchall()
    assert Counter(sql) == Counter(map(tuple, got))


def test_search_takes_items_in_blocks_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 3)
    docs = [(i, f"a{i % 3} b{i % 5} c", "en", "a") for i in range(40)]
    items = [(i, f"a{i % 3} b{i} c zz") for i in range(6)] + [(None, "b1")]
    schema = "item_id long, text string"
    got = lexical_search.lexical_search(table(spark, docs), spark.createDataFrame(items, schema), k=4).collect()
    assert Counter(map(tuple, got)) == brute_search([(i, t) for i, t, *_ in docs], items, 4)
    assert lexical_search.lexical_search(table(spark, docs), spark.createDataFrame([], schema)).collect() == []
    assert lexical_search.lexical_search(table(spark, []), spark.createDataFrame(items, schema)).collect() == []


def test_search_counts_long_texts_in_pieces():
    text = "Ab cd-ab " * 1000 + "z" * 50
    assert "".join(lexical_search.pieces(text, 7)) == text
    n, which, tf = lexical_search.counted(text, {"ab": 3, "z" * 50: 8})
    assert (n, dict(zip(which.tolist(), tf.tolist(), strict=True))) == (3001, {3: 2000, 8: 1})


def test_search_stops_making_accumulators():
    # one document has the rare term; the common one alone cannot reach its score
    ids, n = np.arange(1000), np.full(1000, 10)
    sizes = np.array([2] + [1] * 999)
    terms = np.array([0, 1] + [1] * 999, np.int32)
    block = lexical_search.Block(ids, n, sizes, terms, np.ones(1001, np.int32), 1000, 10000)
    at, scores = block.search(np.array([0, 1]), np.array([7000, 10]), 1, 1)
    assert at.tolist() == [0] and scores[0] == 7000 * block.worth[0] + 10 * block.worth[1]


def test_codecs_of_two_tables_are_two(spark, tmp_path):
    # two rank tables that differ in two ranks only must not share a codec of a worker
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    by_rank = {v: k for k, v in ranks.items()}
    first, second = by_rank[25901], by_rank[41837]
    assert first != second
    keys = []
    for name, table_ in (("a", ranks), ("b", ranks | {first: 41837, second: 25901})):
        path = tmp_path / name
        path.write_text("\n".join(f"{base64.b64encode(k).decode()} {v}" for k, v in table_.items()))
        keys.append(bpe._Blocks(str(path), public_tokenizers.PATTERN, 16, False).key)
    assert keys[0] != keys[1]
