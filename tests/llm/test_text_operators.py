"""Quality rules, BPE, chat, mixing, WARC, HTML, SpotSigs and training order on small and odd inputs."""

import random
import zipfile
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from verdictflow.llm import bpe, chat, common, html_extract, mixing, quality_rules, queries, spotsigs, training_order, warc

SF_DIR = "/root/testdata/sf0.001"
ODD = [(1, None, "a"), (2, "", None), (3, " \t\n", "a"), (4, "one two three", "b"), (4, "one two three", "b"), (5, "w " * 30000, "a"), (None, "null id text here", "b"), (6, "é😀 \x0b x", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(*r, "clash", 7, 8) for r in ODD], "doc_id long, text string, source string, kept string, n_words int, size int")
    return df


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", queries.ORACLES)
def test_matches_duckdb(spark, duck, name):
    found = queries.QUERIES[name](spark, SF_DIR)
    wanted = duck.sql(queries.ORACLES[name])
    cols = sorted(found.columns)
    assert cols == sorted(wanted.columns)
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in found.collect()))) == sorted(map(repr, wanted.project(", ".join(cols)).fetchall()))


def test_rules_on_odd_texts(spark, odd):
    out = {r.doc_id: r for r in quality_rules.apply_rules(odd).collect()}
    assert [out[i].n_words for i in (1, 2, 3)] == [0, 0, 0] and out[1].base_failed and not out[1].kept
    assert out[5].n_words == 30000 and out[5].n_repeat_words == 30000
    assert quality_rules.apply_rules(odd.limit(0)).count() == 0
    stayed = quality_rules.stage(spark, odd, SF_DIR)
    assert stayed.columns == odd.columns and stayed.count() == 0


def test_bpe_matches_the_library(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    codec = bpe.codec_of(open(bpe.default_vocabulary(), encoding="utf-8").read())
    rng = random.Random(3)
    alphabet = ["a", "b", "the", "'s", " ", "\n", "é", "中", "😀", "<|endoftext|>", "\u0085", "​", "1", "###", "\t"]
    for t in ["", "x" * 5000, " " * 3000 + "y", *("".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(2000))]:
        ids = library.encode(t, add_special_tokens=False).ids
        got = codec.encode(t)
        assert list(memoryview(got).cast("I")) == ids
        assert codec.decode(got) == library.decode(ids, skip_special_tokens=False)
    rows = bpe.encode_table(odd, bpe.default_vocabulary()).collect()
    assert len(rows) == len(ODD) and all(r.round_trip for r in rows) and [r.n_tokens for r in rows if r.doc_id == 1] == [0]
    assert bpe.encode_table(odd.limit(0), bpe.default_vocabulary()).count() == 0


def test_stale_entries_are_skipped():
    rules = [(1, 1, 2), (2, 1, 3), (1, 2, 4)]
    ranks = {a << 32 | b: k for k, (a, b, _) in enumerate(rules)}
    assert bpe.merge([1, 1, 1], ranks, rules) == [3]
    assert bpe.merge([1, 1, 1, 1], ranks, rules) == [2, 2]


def test_chat_reads_back_hostile_texts(spark):
    texts = ["\\### Assistant: </turn> ok", "####### <|x|> \\", "", None, "\\\\</turn>\n### a: b", "<\\/turn> #\\##", "a\nb: c"]
    rows = [(1, i, ("user", "assistant", "we:ird ###", None)[i % 4], t) for i, t in enumerate(texts)] + [(2, None, "assistant", "x"), (None, 1, "user", "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.read_back(chat.format_conversations(turns, chat.text_part(F.col("text"))))
    got = {r.conv_id: r for r in out.collect()}
    assert [t.text for t in got[1].turns] == [t or "" for t in texts]
    assert [t.role for t in got[1].turns] == [r[2] or "unknown" for r in rows[:7]]
    at, masked = 0, ""
    for run in got[1].loss_runs:
        masked += got[1].formatted[at : at + run.chars] if run.loss else ""
        at += run.chars
    assert at == len(got[1].formatted) and masked == "".join(chat_escape(t or "") for i, t in enumerate(texts) if i % 4 == 1)
    assert set(got) == {1, 2, None}


def chat_escape(t):
    import re

    return re.sub("#(?=##)", r"#\\", t.replace("\\", "\\\\")).replace("</turn>", "<\\/turn>").replace("<|", "<\\|")


def test_chat_parts(spark):
    parts = "array(named_struct('type','text','text','see <|image:0|>','ref',null,'units',null), named_struct('type','image','text',null,'ref','s3://i','units',2), named_struct('type','audio','text',null,'ref','a','units',3))"
    df = spark.sql(f"SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, {parts} AS parts")
    row = chat.format_conversations(df, F.col("parts")).first()
    assert row.formatted == "### user: see <\\|image:0|><|image:0|><|audio:1|></turn>\n"
    assert [(a.k, a.type, a.ref, a.tokens) for a in row.attachments] == [(0, "image", "s3://i", 512), (1, "audio", "a", 75)] and row.n_tokens == 2 + 587


def brute_targets(sizes, max_epochs=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(max_epochs * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > max_epochs * sizes[s]}
        if not over:
            return {s: max_epochs * sizes[s] if s in capped else share[s] for s in order}
        capped |= over


def test_mixing(spark, odd):
    rows = [(i, "w " * (i % 37 + 1) if i % 11 else None, ("a", "b", "c", None, "é", "z")[i % 6] if i % 5 else "hot") for i in range(1200)] + [(9000 + i, "x y", "tiny") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("doc_id", "source", common.n_words_of(common.text_of()).alias("size"), F.xxhash64("text").alias("content"))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    targets = brute_targets(dict(sizes))
    out = mixing.mix(docs).collect()
    taken = Counter()
    for r in out:
        taken[r.source] += r.size * r["__repeats"]
        assert r["__repeats"] <= 3 and r["__target"] == pytest.approx(targets[r.source])
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 40, s
    assert Counter(map(tuple, mixing.mix(docs).collect())) == Counter(map(tuple, out))
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.stage(spark, odd, SF_DIR).columns == odd.columns


def test_mixing_reruns_agree_on_repeated_and_null_ids(spark, tmp_path, monkeypatch):
    """The query on three orders of rows that share a doc_id, or have none, at different sizes; against its contract."""
    rows = [(7 if i % 2 else None, "w " * (i % 41 + 1) + str(i % 200), "abc"[i % 3], {"k": str(i)}) for i in range(400)] + [(9, None, None, None), (9, "", "a", None)]
    results = []
    for k in range(3):
        random.Random(k).shuffle(rows)
        spark.createDataFrame(rows, "doc_id long, text string, source string, size map<string,string>").repartition(k + 1).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        results.append(Counter(map(tuple, mixing.op4_mixing(spark, f"{tmp_path}/{k}").collect())))
        staged = mixing.stage(spark, spark.read.parquet(f"{tmp_path}/{k}/documents.parquet"), "")
        results.append(Counter((r.doc_id, r.text, r.source) for r in staged.collect()))
    assert results[0] == results[2] == results[4] and results[1] == results[3] == results[5]
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    for (i, t, s), n in results[1].items():
        taken[s] += n * len(t.split())
    targets = brute_targets(dict(sizes))
    assert sum(n for _, n in results[0].items()) == len(rows) and all(abs(taken[s] - t) <= 43 for s, t in targets.items())


def test_op4_against_brute_force(spark):
    """Sizes, source sizes and targets of the query on a whole table, and words taken near the targets."""
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    words = lambda t: len([w for w in (t or "").translate({i: 32 for i in (9, 10, 11, 12, 13)}).split(" ") if w])
    sizes, of = defaultdict(int), {}
    for r in rows:
        sizes[r.source] += words(r.text)
        of[r.doc_id] = (words(r.text), r.source)
    targets, taken = brute_targets(dict(sizes)), defaultdict(int)
    found = mixing.op4_mixing(spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in found) == sorted(of)
    for r in found:
        size, source = of[r.doc_id]
        assert (r.size, r.source_size) == (size, sizes[source]) and r.target == pytest.approx(targets[source])
        assert 0 <= r.taken <= 3 * size and r.taken == size * r.repeats
        taken[source] += r.taken
    longest = max(n for n, _ in of.values())
    assert all(abs(taken[s] - t) <= longest for s, t in targets.items())


def test_warc(spark, tmp_path):
    long = "<p>é" + "x" * 1200
    rows = [(1, "u", long), (2, "u\r\nInjected: x", long), (3, None, None), (4, "u", "short"), (5, "u", "short"), (None, "u", long)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string").drop("digest")
    records, _ = warc.with_leaders(pages)
    packages = common.stored(warc.write_packages(records.coalesce(1), f"{tmp_path}/w", package_bytes=400), "t")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_packages(packages, 2).collect()}
    n = len(long.encode())
    assert got == {1: (n, "revisit", 2), 2: (n, "response", None), 3: (0, "response", None), 4: (5, "response", None), 5: (5, "response", None), None: (n, "revisit", 2)}
    assert packages.count() > 1
    uri = packages.first().uri
    with zipfile.ZipFile(uri) as z:
        assert z.testzip() is None and set(z.namelist()) == {warc.ARCHIVE, warc.INDEX}
    assert warc.read_packages(warc.write_packages(records.limit(0), f"{tmp_path}/e")).count() == 0


def test_zip64_directory(tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(3):
            with z.open(zipfile.ZipInfo(f"m{i}"), "w", force_zip64=True) as f:
                f.write(b"x" * i)
        z.comment = b"PK\x05\x06 in the comment"
    f = warc.RangeFile(str(path))
    found = warc.members(f)
    assert {k: f.read(at, n) for k, (_, at, n) in found.items()} == {"m0": b"", "m1": b"x", "m2": b"xx"}
    with pytest.raises(ValueError):
        f.read(0, 10**6)


PAGE = """<html><head><title>no</title><style>p{}</style></head><body class="has-sidebar"><header><a href=/>Site</a></header><nav><ul><li>Menu</ul></nav>
<form id=all><div id="cookie-notice">We use cookies.</div><main><h1>T &lt;x&gt;</h1><div class="share">Share</div><p>One <i>two</i>&nbsp;three <a href="x?a=1>2">link</a>.<p>Four < five
<ul><li>a<li>b</ul><aside>See</aside><section id="comments"><article class="comment"><p>Nice!</p></article></section><form><label>Name</label></form></main></form><footer>&copy;</footer><script>if(a<b){"</p>"}</script></body>"""


def test_html(spark):
    assert html_extract.extract(PAGE) == "T <x>\nOne two three link.\nFour < five\na\nb"
    pages = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, None, PAGE), (3, None, PAGE), (4, "u", "<p>" * 20000 + "<div 'x>" * 500)], "page_id long, url string, html string")
    got = html_extract.extract_table(pages).collect()
    assert len(got) == 5 and [r.text for r in got[:2]] == ["", ""] and got[2] == got[3] and got[2].n_chars == len(got[2].text)
    assert html_extract.extract_table(pages.limit(0)).count() == 0


def test_cut_is_minimal():
    import itertools

    rng = random.Random(7)
    cost = lambda s, e, m: sum(-x if k and x < 0 else x if not k and x > 0 else 0 for x, k in zip(s, m, strict=True)) + sum(w for (i, j), w in e.items() if m[i] != m[j])
    for _ in range(300):
        n = rng.randrange(1, 8)
        s = [rng.uniform(-3, 3) for _ in range(n)]
        e = {(i, j): rng.uniform(0, 2) for i in range(n) for j in range(i) if rng.random() < 0.6}
        assert cost(s, e, html_extract.minimum_cut(s, e)) == pytest.approx(min(cost(s, e, m) for m in itertools.product((False, True), repeat=n)))


def test_spotsigs(spark, odd):
    rows = [(i, f"the house {i} of cards is very tall and the garden {i * 7} is green") for i in range(5000)] + [(3, "tie b"), (3, "tie a"), (None, "no id"), (7001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = spotsigs.with_next(docs).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    wanted = Counter((i, spotsigs._sha(spotsigs.edited(t, order[(k + 1) % len(order)][1]))) for k, (i, t) in enumerate(order))
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == wanted
    assert spotsigs.with_next(docs.limit(0)).count() == 0
    assert spotsigs.with_next(docs.where("doc_id IS NULL")).count() == 1
    assert len(spotsigs.with_next(odd).collect()) == len(ODD)
    a, b = spotsigs.signatures("x the quick fox of brown dogs"), spotsigs.signatures("")
    assert spotsigs.pruned_jaccard(a, a) == 1.0 and spotsigs.pruned_jaccard(a, b) == 0.0 and spotsigs.pruned_jaccard(b, b) == 1.0 and spotsigs.fingerprint(b) == ""


def test_feistel():
    for n in (1, 2, 3, 17, 4097):
        f = training_order.Feistel(n)
        slots = f.slots(np.arange(n))
        assert sorted(slots) == list(range(n)) and (f.numbers(slots) == np.arange(n)).all()
    assert list(training_order.Feistel(1000, b"k1").slots(np.arange(1000))) != list(training_order.Feistel(1000, b"k2").slots(np.arange(1000)))


def written(spark, docs, folder):
    """The index of 64-id sequences in shards of 100, and the shards' bytes in the order of their slots."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken")) as f:
        source = spark.sparkContext.broadcast(f.read())
    index = training_order.materialise(docs, public_tokenizers.PATTERN, source, folder, 64, 100)
    found = {r.path for r in index.collect()}
    return index, b"".join(open(p, "rb").read() for p in sorted(found, key=lambda p: p.rsplit("/", 1)[1]))


def test_training_order_holds_every_id_once(spark, odd, tmp_path):
    """The stream, read in the order that the permutation tells, against the tokenizers library."""
    import xxhash
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    library.encode_special_tokens = True
    docs = odd.withColumn("ids", F.lit("clash")).withColumn("slot", F.lit("clash"))
    docs = docs.unionByName(spark.createDataFrame([(7, f"tie {i} <|endoftext|>", "a", "k", 1, 1, "x", "x") for i in range(300)], docs.schema))
    _, data = written(spark, docs, f"{tmp_path}/s")
    n = len(data) // 128
    slots = training_order.Feistel(n).slots(np.arange(n))
    stream = np.frombuffer(data, "<u2").reshape(n, 64)[slots].ravel()
    end = len(stream) - int((stream[-64:] == training_order.PAD).sum())
    texts = np.split(stream[:end], np.flatnonzero(stream[:end] == 50256) + 1)[:-1]
    signed = lambda t: int(np.uint64(xxhash.xxh3_64_intdigest(t)).astype(np.int64))
    rows = sorted((r.doc_id is not None, r.doc_id or 0, signed(r.text or ""), r.text or "") for r in docs.collect())
    assert len(texts) == len(rows)
    for got, row in zip(texts, rows, strict=True):
        assert got[:-1].tolist() == library.encode(row[3], add_special_tokens=False).ids


def test_training_order_does_not_follow_the_splits(spark, tmp_path):
    docs = spark.createDataFrame([(i % 90, f"text {i % 70} of a {'longer ' * (i % 40)}document", i) for i in range(600)], "doc_id long, text string, k long")
    first = written(spark, docs.coalesce(1), f"{tmp_path}/1")[1]
    assert first == written(spark, docs.repartition(7, "k"), f"{tmp_path}/7")[1]


def test_training_order_resumes(spark, odd, tmp_path):
    index, data = written(spark, odd, f"{tmp_path}/s")
    rows = training_order.read_back(index, 100).collect()
    assert all(r.read_back and r.shard == r.slot // 100 for r in rows) and {r.doc_id for r in rows} == {r[0] for r in ODD}
    assert sum(r.length for r in rows) + sum(r.length for r in index.where("part < 0").collect()) == len(data) // 2
    for r in random.Random(1).sample(index.collect(), 20):
        at = r.slot // 100 * 100 * 128 + r.offset
        assert training_order.read_from(r.path, r.offset, r.length).tobytes() == data[at : at + 2 * r.length]
    broken = index.withColumn("crc", F.col("crc") + 1)
    assert not any(r.read_back for r in training_order.read_back(broken, 100).collect())
    assert training_order.read_back(written(spark, odd.limit(0), f"{tmp_path}/e")[0]).count() == 0


def test_op6_reads_back_whole_table(spark):
    """The query against the library: each document's pieces, in order, hold its ids and the separator."""
    import hashlib

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    library.encode_special_tokens = True
    found = defaultdict(list)
    for r in queries.QUERIES["op6_training_order"](spark, SF_DIR).collect():
        found[r.doc_id].append(r)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert set(found) == set(docs)
    for doc_id, text in docs.items():
        ids, at = np.array([*library.encode(text, add_special_tokens=False).ids, 50256], "<u2"), 0
        for r in sorted(found[doc_id], key=lambda r: r.part):
            assert r.read_back and r.sha256 == hashlib.sha256(ids[at : at + r.length].tobytes()).hexdigest()
            at += r.length
        assert at == len(ids)
