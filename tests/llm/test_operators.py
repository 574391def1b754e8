"""Every operator against a plain form of the same rule, and on awkward and empty tables."""

from __future__ import annotations

import base64
import itertools
import json
import re
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import (
    fingerprints,
    impact_search,
    language_id,
    mixing,
    near_dedup,
    packing,
    pii,
    queries,
    revisits,
    secrets,
    toxicity,
)

SMALL = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


@pytest.mark.parametrize("name", queries.SQL)
def test_queries_equal_their_sql(spark, name):
    connection = duckdb.connect()
    for table in ("pages", "embeddings", "documents"):
        connection.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    expected = connection.sql(queries.SQL[name]).to_arrow_table()
    actual = queries.QUERIES[name](spark, SMALL).toArrow()
    columns = sorted(expected.column_names)
    assert columns == sorted(actual.column_names)
    a, b = (Counter(zip(*(t[c].to_pylist() for c in columns))) for t in (actual, expected))
    assert a == b and a


def test_secrets_base_kinds_equal_plain_patterns(spark):
    rows = secrets.scan(documents(spark)).collect()
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    for row in rows:
        found = []
        for m in re.finditer(
            r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
            texts[row.doc_id],
        ):
            found += [(m.start(), 0, "assign", m.end())] if len(m[2]) >= 8 else []
        for k, (kind, pattern, least) in enumerate(
            (("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32)), 1
        ):
            found += [
                (m.start(), k, kind, m.end())
                for m in re.finditer(pattern, texts[row.doc_id])
                if len(m[0]) >= least
            ]
        listed = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found))
        assert row.base_sha256 == sha256(listed.encode()).hexdigest()


def test_secrets_are_confirmed_by_structure():
    number = b"\x02\x21\x00" + bytes(range(0x80, 0xA0))
    body = b"\x02\x01\x00" + number * 5
    der = b"\x30\x81" + bytes([len(body)]) + body
    part = lambda x: len(x).to_bytes(4) + x
    public = part(b"ssh-ed25519") + part(bytes(32))
    ssh = b"openssh-key-v1\0" + part(b"none") * 2 + part(b"") + (1).to_bytes(4) + part(public) + part(bytes(128))
    head = base64.urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).decode().rstrip("=")
    token = f"{head}.{base64.urlsafe_b64encode(b'{}').decode().rstrip('=')}.c2ln"
    text = f"a {base64.b64encode(der).decode()} b {ssh.hex()} c {token} {base64.b64encode(bytes(40)).decode()}"
    assert [kind for kind, *_ in sorted(secrets.confirmed_spans(text), key=lambda s: s[1])] == [
        "der_key",
        "ssh_key",
        "token",
    ]
    assert not secrets.is_der_key(der[:-1]) and not secrets.is_ssh_key(ssh + b"x")
    assert not secrets.is_ssh_key(public)


def test_secrets_without_a_long_run_are_scanned(spark):
    head = base64.urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).decode().rstrip("=")
    token = f"{head}.{base64.urlsafe_b64encode(b'{}').decode().rstrip('=')}.c2ln"
    number = b"\x02\x21\x00" + bytes(range(0x80, 0xA0))
    body = b"\x02\x01\x00" + number * 5
    coded = base64.b64encode(b"\x30\x81" + bytes([len(body)]) + body).decode()
    lines = "\n".join(coded[i : i + 20] for i in range(0, len(coded), 20))
    key = f"-----BEGIN PRIVATE KEY-----\n{lines}\n-----END PRIVATE KEY-----"
    rows = [(1, f"a {token} b"), (2, f"a {key} b"), (3, "eyJ -----BEGIN x"), (4, None)]
    found = secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.spans for r in found} == {
        1: f"token:2:{2 + len(token)}", 2: f"pem_key:2:{2 + len(key)}", 3: "", 4: ""
    }


@pytest.mark.parametrize("listed", [64, 1])
def test_near_duplicates_equal_all_pairs(spark, listed):
    docs = documents(spark).collect()
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(r.doc_id, r.text) for r in docs]
    for k in range(60):  # scattered edits of one text, some of them near the limit
        words = list(base)
        for i in rng.choice(120, k % 14, replace=False):
            words[i] = f"x{k}_{i}"
        rows.append((10_000 + k, " ".join(words)))
    sets = {i: shingles(t, 2) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = near_dedup.near_duplicates(table, 2, 80, listed=listed, block=16).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found} == {
        (i, len(sets[i]), find(i)) for i in sets
    }


def test_near_duplicates_of_awkward_rows(awkward, nothing):
    found = [tuple(r) for r in near_dedup.near_duplicates(awkward).collect()]
    assert Counter(found)[(1, 7, 1, True)] == 2
    assert (None, 7, None, True) in found and (2, 0, 2, True) in found and (3, 0, 3, True) in found
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_revisits_span_pieces_and_merge_permitted_fields(spark):
    rows = [(0, "http://www.A.com:80/x/?b=2&a=1&utm_source=q#f", 0, "response", {"etag": '"1"', "age": "3"})]
    rows += [(i, "https://a.com/x?a=1&b=2", i, "revisit", {"etag": 'W/"1"', "date": str(i), "age": "9"}) for i in range(1, 40)]
    rows += [(90, None, 5, "revisit", {"etag": '"1"'}), (91, "http://b.com", 5, "revisit", None)]
    rows += [(92, "http://a.com/x?a=1&b=2", 99, "revisit", {}), (93, "http://a.com/x?a=1&b=2", 99, "revisit", {"etag": '"2"'})]
    table = spark.createDataFrame(rows, "record_id bigint, url string, captured_at int, kind string, headers map<string,string>")
    found = {r.record_id: r for r in revisits.resolve(table, pieces=7).collect()}
    assert all(found[i].state == "resolved" and found[i].refers_to == 0 for i in range(1, 40))
    assert found[39].headers == {"etag": 'W/"1"', "date": "39", "age": "3"}
    states = [found[i].state for i in (0, 90, 91, 92, 93)]
    assert states == ["response", "orphan", "orphan", "unvalidated", "mismatch"]
    assert revisits.resolve(table.limit(0)).count() == 0


def test_top_k_of_awkward_vectors(spark):
    rows = [(0, [1.0, -2.0]), (1, [1.0, -2.0]), (2, [1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, []), (None, [1.0, 1.0]), (7, [1.0, -2.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    vectors = table.select("vec_id", impact_search.whole("embedding").alias("vector"))
    index = impact_search.build(vectors, block_rows=2)
    found = impact_search.search(index, vectors.filter("vec_id = 0"), k=3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(1, 5 << 20), (7, 5 << 20), (2, 1 << 20)]
    empty = impact_search.build(vectors.limit(0))
    assert impact_search.search(empty, vectors).count() == 0


def test_surrogates_are_distinct_consistent_and_shaped():
    keyed = pii.Keyed("k")
    phones = [f"1 {456_555_0000 + i}" for i in range(3000)]
    assert len({keyed.surrogate("phone", p) for p in phones}) == len(phones)
    card = "4111111111111111"
    assert pii.luhn(keyed.surrogate("card", card)) and keyed.surrogate("card", card)[0] == "4"
    for group, names in pii.NAMES.items():
        made = [keyed.surrogate("person", n) for n in names]
        assert sorted(made) == sorted(names) and not any(a == b for a, b in zip(made, names)), group
    text = "Mr. Daniel Smith, +1 (456) 555-2186 or +1 456 555 2186, a.b@x.org, 10.0.0.255, 2024-01-02"
    kinds = [kind for _, _, kind, _ in pii.mentions(text)]
    assert kinds == ["person", "family", "phone", "phone", "email", "ipv4"]
    assert len({e for *_, kind, e in pii.mentions(text) if kind == "phone"}) == 1


@pytest.mark.parametrize(
    "text, names",
    [
        ("John Smith came. Then Smith's dog left, and John too.", {"John": 2, "Smith": 2}),
        ("Smith was here: Mr. Smith, of Smith-Jones", {"Smith": 3}),
        ("Alice Miller asked. Alice replied.", {"Alice": 2, "Miller": 1}),
        ("John A. Smith and John B. C. Smith", {"John": 2, "A": 1, "B": 1, "C": 1, "Smith": 2}),
        ("Dr. J. R. Smith and John Q Smith", {"John": 1, "J": 1, "R": 1, "Q": 1, "Smith": 2}),
        ("John O'Brien, or O’Brien", {"John": 1, "O'Brien": 2}),
        ("Anna McDonald and Mrs McDonald", {"Anna": 1, "McDonald": 2}),
        ("John Smith is no Smithson, nor Blacksmith or xSmith", {"John": 1, "Smith": 1}),
        ("John Smith, John.Smith@x.org, Smith", {"John": 1, "Smith": 2, "John.Smith@x.org": 1}),
    ],
)
def test_every_mention_of_a_name_has_its_surrogate(spark, text, names):
    assert Counter(e for *_, e in pii.mentions(text)) == names
    keyed, expected = pii.Keyed("k"), text
    spans = pii.mentions(text)
    assert all(a[1] <= b[0] for a, b in itertools.pairwise(spans))
    for start, end, kind, entity in reversed(spans):
        made = keyed.surrogate(kind, entity)
        assert made != entity
        made = made.replace("'", "’") if "’" in text[start:end] else made
        expected = expected[:start] + made + expected[end:]
    found = pii.replaced(spark.createDataFrame([(text,)], "text string"), "k").first()
    assert (found.text, found.n_entities) == (expected, sum(names.values()))


def test_surrogates_of_awkward_rows(awkward, nothing):
    found = pii.with_surrogates(awkward, "k")
    assert found.count() == 9 and found.filter("text is null and n_entities = 0").count() == 1
    assert pii.with_surrogates(nothing, "k").count() == 0


def test_toxicity_of_held_out_rows(spark, awkward, nothing):
    rows = [(i, f"text number {i} " + ("you idiot" if i % 4 == 0 else "you friend"), int(i % 4 == 0)) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    model = toxicity.fit(table.filter("doc_id < 300"), table)
    found = toxicity.score(table.filter("doc_id >= 300"), model).collect()
    assert all(r.predicted == r.label for r in found)
    assert all(0 <= r.score <= 1 for r in toxicity.score(awkward, model).collect())
    bare = toxicity.fit(table.limit(0), table)
    assert [r.score for r in toxicity.score(awkward, bare).limit(1).collect()] == [0.5]
    assert toxicity.score(nothing, model).count() == 0


def test_packing_equals_the_tokenizer(spark, awkward, nothing):
    from tokenizers import Tokenizer

    file = queries.tokenizer_file()
    whole = Tokenizer.from_file(file)
    for docs in (documents(spark), awkward):
        ids = [whole.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()]
        found = packing.packed(docs, file).collect()
        assert sorted(r.sequence_id for r in found) == list(range(len(found)))
        assert sum(r.length for r in found) == sum(map(len, ids))
        assert all(r.length & (r.length - 1) == 0 and r.length <= 2048 for r in found)
        parts = defaultdict(dict)
        for r in found:
            assert crc32(r.ids) == r.ids_crc32
            parts[r.doc_id].setdefault(r.start, r.ids)
        made = {b"".join(p[k] for k in sorted(p)) for p in parts.values()}
        assert made == {np.array(x, "<u4").tobytes() for x in ids}
    assert packing.packed(nothing, file).count() == 0


def test_language_of_held_out_rows(spark, awkward, nothing):
    found = queries.op8_language_id(spark, SMALL).filter("held_out").join(documents(spark), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.9 * len(found)
    model = language_id.fit(documents(spark))
    got = {r.doc_id: r for r in language_id.predict(awkward, model).collect()}
    assert [got[i].lang_pred for i in (2, 3, 5, 7)] == ["und"] * 4
    assert got[1].lang_pred == "en" and got[1].score != "x"
    none = language_id.fit(nothing)
    assert {r.lang_pred for r in language_id.predict(awkward, none).collect()} == {"und"}
    assert language_id.predict(nothing, model).count() == 0


def plain_bits(texts, text, order=4):
    """Code length by the rule itself, from one language's texts."""
    seen = defaultdict(Counter)
    for one in texts:
        data = b" " * order + one.encode()
        for i, k in itertools.product(range(order, len(data)), range(order + 1)):
            seen[data[i - k : i]][data[i]] += 1
    bits, data = 0.0, b" " * order + text.encode()
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            if found := seen.get(data[i - k : i]):
                total, kinds = sum(found.values()), len(found)
                if n := found[data[i]]:
                    bits += np.log2((total + kinds) / n)
                    break
                bits += np.log2((total + kinds) / kinds)
        else:
            bits += 8
    return bits


def test_code_lengths_of_a_language_with_few_short_texts_are_exact(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(words, 150)), "big") for i in range(40)]
    rows += [(100 + i, f"zqx vjk {i} qzw", "few") for i in range(3)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.languages == ["big", "few"]
    asked = ["zqx vjk 1 qzw", "zqx", "qzw zqx é", rows[0][1][:300], ""]
    data = np.frombuffer("".join(asked).encode(), np.uint8)
    ends = np.cumsum([0, *(len(a.encode()) for a in asked)])
    found = language_id.code_lengths(model, data, ends) / 65536
    for lang, bits in zip(model.languages, found.T):
        texts = [text for _, text, own in rows if own == lang]
        assert np.allclose(bits, [plain_bits(texts, a) for a in asked], atol=0.01), lang


def test_long_texts_are_scored_in_pieces_alike(spark):
    model = language_id.fit(documents(spark))
    data = np.frombuffer(b"the cat and the hat " * 150_000, np.uint8)
    whole = language_id._piece(model, len(model.costs) // language_id._nodes(model), data, np.array([0, len(data)]), None)
    assert (language_id.code_lengths(model, data, np.array([0, len(data)])) == whole).all()


def test_fingerprints_estimate_similarity(spark, awkward, nothing):
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    order = sorted(texts, reverse=True)
    errors = []
    for r in fingerprints.with_edits(documents(spark)).collect():
        text, after = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha256(edited.encode()).hexdigest())
        a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (text.split(), edited.split()))
        errors.append(r.near_edited - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.02 and np.mean(np.abs(errors)) < 0.06
    found = fingerprints.with_edits(awkward).collect()
    assert len(found) == 9 and len({r.fingerprint for r in found if r.doc_id in (None, 1)}) == 1
    assert fingerprints.with_edits(nothing).count() == 0


def test_fingerprints_fill_bins_as_a_plain_loop_does(spark):
    texts = [None, "", " \t", "one", "a b c d e f", "x y " * 30, *(" ".join(map(str, range(n))) for n in (12, 90, 3000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    hashes = dict(docs.select("doc_id", fingerprints.shingle_hashes(F.col("text"), 5)).collect())
    b = F.col("id").cast("int")
    probes = [
        [(r.start + t * (r.step % 64 * 2 + 1)) % 128 for t in range(128)]
        for r in spark.range(128).orderBy("id").select(*(F.xxhash64(b, F.lit(c)).alias(c) for c in ("start", "step"))).collect()
    ]
    found = fingerprints.with_edits(docs)
    for r in found.collect():
        least = {}
        for h in hashes[r.doc_id] or []:
            bin_ = h % 2**64 >> 57
            least[bin_] = min(h, least.get(bin_, h))
        low = [least[next(p for p in (b, *probes[b]) if p in least)] % 16 for b in range(128) if least]
        plain = "".join(f"{v:x}" for k in range(0, len(low), 16) for v in reversed(low[k : k + 16]))
        assert r.fingerprint == plain, texts[r.doc_id]
    # The order of probes is a constant: no bin of no row hashes its number again.
    assert not re.search(r"xxhash64\([^()]*\b(start|step)\b", found._jdf.queryExecution().optimizedPlan().toString())


def test_mixing_meets_targets(spark, awkward, nothing):
    for docs in (documents(spark), awkward):
        found = mixing.mixed(docs).collect()
        assert len(found) == docs.count()
        by = defaultdict(list)
        for r in found:
            assert 0 <= r.taken <= 3 * r.size
            by[r.source].append(r)
        total = sum(r.size for r in found)
        for rows in by.values():
            assert sum(r.size for r in rows) == rows[0].source_size
            assert rows[0].target <= 3 * rows[0].source_size + 1e-6
            # About a part of the document that the source serves at the end.
            part = max(r.size for r in rows) / mixing.PACKETS + 2
            assert abs(sum(r.taken for r in rows) - rows[0].target) <= 2 * part
        assert abs(sum(rows[0].target for rows in by.values()) - total) < 1e-3
    assert mixing.mixed(nothing).count() == 0


def test_pipeline_keeps_its_columns(spark):
    import corpus_pipeline

    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == corpus_pipeline.COLUMNS, name
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_mixing_stage_keeps_rows_without_an_id(spark):
    import corpus_pipeline

    rows = [(None, "one two three", "en", "a", 13, 9), (1, "four five six", "en", "a", 13, 9), (2, None, None, None, 0, 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, times int")
    kept = corpus_pipeline.mix(spark, docs, SMALL)
    assert kept.columns == corpus_pipeline.COLUMNS
    assert {r.doc_id for r in kept.collect()} == {None, 1}


def test_mixing_stage_holds_targets_of_rows_that_share_an_id(spark):
    import corpus_pipeline

    # By weight 5, 2 and 1 of 4000 words, b and c get less than they have, a takes more passes.
    rows = [(None if i % 3 else 7, f"{s} {i} x y", "en", s, 9) for s, n in (("a", 200), ("b", 400), ("c", 400)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = Counter((r.source, r.text) for r in corpus_pipeline.mix(spark, docs, SMALL).collect())
    targets = {r.source: r.target for r in mixing.mixed(docs).select("source", "target").distinct().collect()}
    assert targets["b"] < 1600 and targets["c"] < 1600
    for source, target in targets.items():
        assert abs(4 * sum(n for (s, _), n in kept.items() if s == source) - target) <= 4
    assert set(kept) <= {(r[3], r[1]) for r in rows}
    assert max(n for (s, _), n in kept.items() if s != "a") == 1
