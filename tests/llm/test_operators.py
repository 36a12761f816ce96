"""Each corpus operator against a plain version, and on nulls, ties, empty tables and clashing names."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from heaploom.llm import bpe, components, decontaminate, licenses, near_dup, passages, pii, queries, sharding, toxicity, vectors, warc

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], DOCS).repartition(3)


def prose(draw, n, size=400):
    return " ".join(f"w{draw.randrange(size)}" for _ in range(n))


# -- sharding ---------------------------------------------------------------------


def test_sharding(spark):
    draw = random.Random(1)
    texts = [None, "", "é" * 50] + ["x" * draw.randrange(200) for _ in range(300)] + ["same"] * 100
    found = sharding.shard_by_bytes(frame(spark, texts, [*range(303), *[7] * 100]), 5).collect()
    assert len(found) == 403
    assert sorted((r["size"], r["text_crc32"]) for r in found) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts)
    by = {s: [r for r in found if r["shard"] == s] for s in range(5)}
    mean, largest = sum(r["size"] for r in found) / 5, max(r["size"] for r in found)
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        assert abs(sum(r["size"] for r in rows) - mean) <= largest
    for s in range(4):
        assert max(r["doc_id"] for r in by[s]) <= min(r["doc_id"] for r in by[s + 1])
    assert sharding.shard_by_bytes(frame(spark, []), 5).count() == 0


def test_sharding_equals_its_sql(spark, tmp_path):
    import duckdb

    draw = random.Random(4)
    texts = [None, "", "é" * 50, "x" * 9000] + ["y" * draw.randrange(300) for _ in range(200)] + ["same"] * 80
    frame(spark, texts, [None, *range(203), *[7] * 80]).write.parquet(str(tmp_path / "documents.parquet"))
    names = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    found = [tuple(r[c] for c in names) for r in queries.op5_sharding(spark, str(tmp_path)).collect()]
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        wanted = con.execute(f"SELECT {', '.join(names)} FROM ({queries.OP5_SQL})").fetchall()
    assert sorted(found, key=repr) == sorted(wanted, key=repr)


# -- WARC -------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 100
    rows = [(3, "http://a\r\nX: y", big), (1, None, big), (2, "u", None), (5, "u", "small"), (4, "u", "small"), (1, "again", big), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc.round_trip(pages).collect()
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in found)
    n = len(big.encode())
    assert kinds == sorted(
        [("3", "revisit", 1, n), ("1", "response", None, n), ("1", "response", None, n), ("2", "response", None, 0), ("5", "response", None, 5), ("4", "response", None, 5), ("None", "revisit", 1, n)]
    )
    assert {r["payload_digest"] for r in found} == {hashlib.sha256(t.encode()).hexdigest() for t in (big, "", "small")}
    assert warc.round_trip(pages.limit(0)).count() == 0


def packed(*records):
    out = b""
    for record in records:
        member = zlib.compressobj(1, zlib.DEFLATED, 31)
        out += member.compress(record) + member.flush()
    return out


def test_warc_reader_refuses_damage():
    import io

    record = warc.record_bytes(1, "u", b"body", hashlib.sha256(b"body").hexdigest(), None)
    data = packed(record)
    for chunk in (1, 5, 1 << 16):
        assert [block for _, block in warc.read_records(io.BytesIO(data * 3), chunk)] == [b"body"] * 3
    assert list(warc.read_records(io.BytesIO(b""))) == []
    bad = [record.replace(b"body", b"bodx"), record.replace(b"Content-Length: 4", b"Content-Length: 5"), record.replace(b"Content-Length: 4", b"Content-Length: 3")]
    bad += [record.replace(b"Content-Length: 4", b"Content-Length: -4"), b"HTTP/1.1\r\n\r\n", b"WARC/1.1\r\n" + b"x" * (2 << 20), record + b"more"]
    for broken in [data[:-9], data + b"\x1f", *map(packed, bad)]:
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(broken)))


def test_warc_reads_archives_of_other_writers(spark, tmp_path):
    body = b"<html>" + b"long text " * 50_000
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    sha1 = lambda x: base64.b32encode(hashlib.sha1(x).digest())
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 14\r\n\r\nsoftware: some\r\n\r\n"
    head = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID:\r\n <urn:uuid:2>\r\nWARC-Target-URI: http://a/\r\nContent-Type: application/http; msgtype=response\r\n"
    head += b"WARC-Block-Digest: sha1:" + sha1(http) + b"\r\nWARC-Payload-Digest: sha1:%s\r\n" + b"Content-Length: " + str(len(http)).encode() + b"\r\n\r\n" + http + b"\r\n\r\n"
    again = b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:uuid:3>\r\nWARC-Payload-Digest: sha1:" + sha1(body) + b"\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(packed(info, head.replace(b"%s", sha1(body)), again))
    (tmp_path / "b.warc.gz").write_bytes(packed(head.replace(b"%s", sha1(b"other"))))
    paths = lambda name: spark.createDataFrame([(str(tmp_path / name),)], "path string")
    rows = warc.read_archives(paths("a.warc.gz"), tmp_path.as_uri(), with_payload=True).collect()
    assert [(r["page_id"], r["url"], r["record_type"], r["payload_bytes"], r["refers_to"]) for r in rows] == [
        ("<urn:uuid:1>", None, "warcinfo", 14, None), ("<urn:uuid:2>", "http://a/", "response", len(body), None), ("<urn:uuid:3>", None, "revisit", None, None)
    ]
    assert bytes(rows[1]["payload"]) == body and rows[1]["payload_digest"] == hashlib.sha256(body).hexdigest()
    assert rows[2]["payload_digest"] == "sha1:" + sha1(body).decode() and rows[2]["payload"] is None
    with pytest.raises(Exception, match="payload digest does not fit"):
        warc.read_archives(paths("b.warc.gz"), tmp_path.as_uri()).collect()


# -- BPE --------------------------------------------------------------------------


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = bpe.default_path()
    library = Tokenizer.from_file(path)
    draw = random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "é", "1", "'s", "'", "!", "日本", "<|endoftext|>", "<|", "😀", "́", "A"]
    for leaf in (8, 16):
        tree = bpe.TreeBpe(path, leaf)
        for _ in range(600):
            some = draw.sample(parts, draw.randint(1, len(parts)))
            text = "".join(draw.choice(some) for _ in range(draw.randint(0, 60)))
            ids = library.encode(text, add_special_tokens=False).ids
            assert tree.encode(text) == ids
            assert tree.decode(ids) == library.decode(ids, skip_special_tokens=False)
            noise = [draw.randrange(50257) for _ in range(5)]
            assert tree.decode(noise) == library.decode(noise, skip_special_tokens=False)
    tree = bpe.TreeBpe(path, 500)
    for text in ("a" * 5000, " " * 4000 + "x", "thequick" * 900, "!" * 3000 + "abc"):
        assert tree.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_windows_grow_until_both_sides_agree():
    from tokenizers import Tokenizer

    path = bpe.default_path()
    library = Tokenizer.from_file(path)
    draw = random.Random(6)
    grown = 0
    for text in [prose(draw, 400), "ab" * 300 + " end", " " * 500 + "x", "one  two\n\n three's " * 40, "1234567890" * 80, "日本語。" * 100]:
        tree = bpe.TreeBpe(path, 32, window_chars=2)
        assert tree.encode(text) == library.encode(text, add_special_tokens=False).ids
        joins = len(tree.leaves(text)) - 1
        assert tree.tried >= joins > 0
        grown += tree.tried - joins
    assert grown > 50


def test_bpe_long_and_null_texts(spark):
    draw = random.Random(2)
    texts = [None, "", prose(draw, 3000), prose(draw, 20), "x" * 9000, "<|endoftext|>" * 300]
    tree = bpe.TreeBpe(bpe.default_path())
    found = {r["doc_id"]: r for r in bpe.decode(bpe.encode(frame(spark, texts), leaf_chars=1000)).collect()}
    assert len(found) == 6
    for i, t in enumerate(texts):
        assert found[i]["ids"] == tree.encode(t or "") and found[i]["text"] == (t or "")
    assert bpe.encode(frame(spark, [])).count() == 0


# -- decontamination ----------------------------------------------------------------


def test_contamination(spark):
    draw = random.Random(3)
    items = [prose(draw, 25, 30), prose(draw, 12, 30), "Rare Pair", "É w1", "", None, "one", prose(draw, 25, 30)]
    texts = [None, "", "one", "rare, PAIR rare pair", "é w1 É W1", items[0] + " tail", "head " + items[1], prose(draw, 3000, 30), items[0][10:80], items[3]] * 2
    bench = spark.createDataFrame([(100 + i, t) for i, t in enumerate(items)] + [(None, items[1])], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.contamination(frame(spark, texts), bench).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        w, hit, which = words(text), set(), set()
        for k, item in enumerate(items):
            x = words(item)
            for s in range(max(1, len(x) - 9)) if x else ():
                window = x[s : s + 10]
                for p in range(len(w) - len(window) + 1):
                    if w[p : p + len(window)] == window:
                        hit.update(range(p, p + len(window)))
                        which.add(str(100 + k))
        assert (found[i]["n_words"], found[i]["n_hit"], found[i]["items"]) == (len(w), len(hit), sorted(which))
    assert decontaminate.contamination(frame(spark, []), bench).count() == 0
    assert decontaminate.contamination(frame(spark, ["a b"]), bench.limit(0)).first()["n_hit"] == 0
    left = decontaminate.drop_contaminated(frame(spark, texts), bench)
    assert left.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i in found if not found[i]["n_hit"])


def test_proximity(spark):
    texts = ["a x x b x x c", "a b c", "b x x x x x x x a c", "a a"]
    queries = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["zz", "a"]), (3, ["c"])], "phrase int, window array<string>")
    index = decontaminate.build_index(frame(spark, texts).coalesce(1).orderBy("doc_id"), queries.select(F.col("phrase").alias("item_id"), F.col("window").alias("words")))
    near = decontaminate.proximity_matches(index, queries, 4).join(index.docs, "row").collect()
    # The rarest word of the first group is b: in text 0 c is three words away, in text 2 a is eight away.
    assert {(r["phrase"], r["doc_id"]) for r in near} == {(1, 0), (1, 1), (3, 0), (3, 1), (3, 2)}


# -- licences -----------------------------------------------------------------------


def test_licenses(spark):
    apache = licenses.TEMPLATES["apache"][0]
    texts = [None, "", "the MIT License, mit license", "x " * 50 + apache, apache.replace("obtain a copy", "get one"), "mit. License CC-BY 4", "gnu General public license gnu"]
    found = {r["doc_id"]: r for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        w = words(text)
        places = [p for phrase in licenses.BASE_PHRASES for x in [phrase.split()] for p in range(len(w) - len(x) + 1) if w[p : p + len(x)] == x]
        r = found[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(places, default=None), max(places, default=None))
    assert found[2]["base_labels"] == "mit" and found[5]["base_labels"] == "cc-by,mit" and found[6]["base_labels"] == "gpl"
    assert found[3]["spans"][0]["first"] == 50 and found[3]["spans"][0]["cover"] == 1.0
    assert "apache" in found[4]["labels"] and found[4]["score"] == 1.0
    assert licenses.scan_licenses(frame(spark, [])).count() == 0


def test_suffix_automaton():
    draw = random.Random(4)
    sequences = [[draw.randrange(3) for _ in range(draw.randrange(1, 12))] for _ in range(4)]
    automaton = licenses.SuffixAutomaton(sequences)
    text = [draw.randrange(4) for _ in range(300)]
    for k, (length, state) in enumerate(automaton.statistics(text)):
        holds = lambda n, k=k: [(j, e) for j, s in enumerate(sequences) for e in range(n - 1, len(s)) if s[e - n + 1 : e + 1] == text[k - n + 1 : k + 1]]
        best = max((n for n in range(k + 2) if n == 0 or holds(n)), default=0)
        assert length == best
        if length:
            assert automaton.ends[state] == {j: min(e for i, e in holds(length) if i == j) for j, _ in holds(length)}


def test_license_chains_keep_all_places():
    scanner = licenses.LicenseScanner()
    bsd = licenses.TEMPLATES["bsd"][0]
    edited_ = bsd.replace("must reproduce", "must contain").replace("in the documentation", "within the documentation")
    assert edited_.count("must contain") == edited_.count("within the documentation") == 1
    for text, copies in [(edited_, 1), (f"{edited_} {edited_}", 2)]:
        spans = [s for s in scanner.scan(f"x y {text} z")[5] if scanner.labels[s[0]] == "bsd"]
        assert [(s[1], s[2]) for s in spans] == [(2 + 134 * k, 136 + 134 * k) for k in range(copies)]
        assert all(s[3] == pytest.approx(132 / 134) for s in spans)


def test_license_near_misses():
    scanner = licenses.LicenseScanner()
    labels = lambda text: {scanner.labels[s[0]] for s in scanner.scan(text)[5]}
    for text in ("It was released under the old name.", "Released under the Apache 2 terms", "SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: AGPL-3.0-or-later"):
        assert labels(text) == set() and scanner.scan(text)[6] == 0
    for label, templates in licenses.TEMPLATES.items():
        for template in templates:
            assert labels(template) == {label}
    assert labels("SPDX-License-Identifier: GPL-3.0-only") == {"gpl"}
    assert labels("Copyright (c) 2020 Somebody. All rights reserved.") == {"all-rights-reserved"}


# -- personal data ---------------------------------------------------------------------


def plain_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_spans():
    draw = random.Random(1)
    parts = ["1", "4111 1111 1111 1111", ".", "@", "a.b", "-", "+", "+1 ", " ", "25", "300", "(", ")", "x", "%", "é", "\n", "4242424242424242"]
    for _ in range(4000):
        t = "".join(draw.choice(parts) for _ in range(draw.randint(0, 25)))
        assert pii.base_spans(t) == plain_spans(t)
    assert pii.base_spans("a" * 300_000 + "1" * 200_000 + "." * 1000) == []


def test_skip_chain(spark):
    draw = random.Random(2)
    texts = [None, ""] + [f"{prose(draw, 20)} mail a{k}@ex.org or 10.0.0.{k} {prose(draw, 9)}" for k in range(40)]
    texts += ["see 4111111111111111 4111111111111111 twice", "card 4111111111111111 here", "card 4242424242424242 there"]
    docs = frame(spark, texts)
    found = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    for i, t in enumerate(texts):
        assert [(s["kind"], s["start"], s["end"]) for s in found[i]["base"]] == plain_spans(t or "")
        assert all(not (a["start"] < b["end"] and b["start"] < a["end"]) for a in found[i]["added"] for b in found[i]["base"])
    assert [s["kind"] for s in found[42]["added"]] == ["card"] and not found[42]["base"]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[0] is None and clean[1] == "" and "[EMAIL]" in clean[2] and "[IP]" in clean[2] and "@" not in clean[2] and "41111" not in clean[42]
    assert pii.find_pii(frame(spark, [])).count() == 0


def test_secrets_are_added(spark):
    draw = random.Random(8)
    key = lambda n=40, of="0123456789abcdef": "".join(draw.choices(of, k=n))
    forms = ['token = "{}"', "api_key={}", "password: {}", "The secret is {} .", '"access_key":"{}"']
    texts = [f"{prose(draw, 9)} {forms[k % 5].format(key())} {prose(draw, 9)}" for k in range(100)]
    again = key()
    texts += [f'token = "{again}" {prose(draw, 30)} see {again} there', f"use AKIA{key(16, 'ABCDEFGHJK234567')} {prose(draw, 5)}"]
    clean = [f"{prose(draw, 9)} commit {key()} build-{k}-of-2024 {prose(draw, 9)}" for k in range(100)] + ["the token is gone", "secret = 12", "password: " + "x" * 30]
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["added"]] for r in pii.find_pii(frame(spark, texts + clean)).collect()}
    for i, t in enumerate(texts[:100]):
        assert [k for k, *_ in found[i]] == ["secret"] and re.fullmatch("[0-9a-f]{40}", t[found[i][0][1] : found[i][0][2]])
    assert [texts[100][a:b] for _, a, b in found[100]][0] == again
    assert all(not found[len(texts) + k] for k in range(len(clean)))
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, texts + clean)).collect()}
    assert "[SECRET]" in redacted[0] and redacted[len(texts)] == clean[0]


def test_message_passing_is_exact_on_a_chain():
    draw = np.random.default_rng(1)
    n = len(pii.LABELS)
    model = pii.SkipChain({k: draw.normal(size=n) for k in range(4)}, np.zeros(n), draw.normal(size=(n, n)), np.zeros((n, n)))
    model.chain = model.chain + model.chain.T
    got = model.beliefs([0, 1, 2], [(0, 1), (1, 2)], [], rounds=60)
    joint = np.exp(model.unary[0][:, None, None] + model.unary[1][None, :, None] + model.unary[2][None, None] + model.chain[:, :, None] + model.chain[None])
    for k, axes in enumerate(((1, 2), (0, 2), (0, 1))):
        assert np.allclose(got[k] / got[k].sum(), joint.sum(axes) / joint.sum(), atol=1e-6)


# -- toxicity --------------------------------------------------------------------------


def test_toxicity(spark):
    draw = random.Random(6)
    texts, toxic = [None, ""], [0, 0]
    for k in range(700):
        bad = k % 5 == 0
        w = prose(draw, 60).split()
        for _ in range(4 * bad):
            w[draw.randrange(60)] = draw.choice(["scum", "idiot", "trash"])
        texts.append(" ".join(w))
        toxic.append(int(bad))
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(0, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    found = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [i for i in range(2, 702) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sorted(i for i, r in found.items() if r["held_out"] and i > 1) == held
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found.values())
    assert sum(found[i]["predicted"] == toxic[i] for i in held) >= 0.95 * len(held)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in found.items() if not r["predicted"])
    # Words joined by shuffle score as words that every task holds.
    apart = toxicity.learn(docs, labels, model_words=0)
    assert apart.held is None and all(abs(r["score"] - found[r["doc_id"]]["score"]) < 1e-9 for r in toxicity.score_toxicity(docs, apart).collect())
    assert sorted(r["doc_id"] for r in toxicity.keep_clean(docs.withColumns({c: F.lit(1) for c in ("document", "number", "f0", "score")}), apart).collect()) == sorted(i for i, r in found.items() if not r["predicted"])
    unlabelled = toxicity.learn(docs, labels.limit(0))
    assert {round(r["score"], 9) for r in toxicity.score_toxicity(docs, unlabelled).collect()} == {0.5}
    assert toxicity.score_toxicity(frame(spark, []), model).count() == 0


def test_kneser_ney_against_plain_counts(spark):
    draw = random.Random(16)
    texts = [prose(draw, 120, 60) for _ in range(60)]
    toxic = [k % 3 == 0 for k in range(60)]
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)], "doc_id long, toxic int")
    model = toxicity.learn(frame(spark, texts), labels)
    pairs = [set(), set()]
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 4 < 2:
            pairs[toxic[i]] |= {*zip(["", *words(t)], words(t), strict=False)}
    count = [{}, {}, {}]
    for k, some in enumerate([*pairs, pairs[0] | pairs[1]]):
        for _, w in some:
            count[k][w] = count[k].get(w, 0) + 1
    got = dict(zip(model.held[0].tolist(), model.held[1].tolist(), strict=True))
    for w in count[2]:
        base = (count[2][w] + 0.1) / (sum(count[2].values()) + 0.1 * len(count[2]))
        p = [(max(c.get(w, 0) - 3, 0) + sum(min(x, 3) for x in c.values()) * base) / sum(c.values()) for c in count[:2]]
        assert got.get(toxicity.word_hash(w.encode()), model.default) == pytest.approx(np.log(p[1] / p[0]))
    assert 0 < len(got) < len(count[2]) or len(got) == len(count[2])


# -- components and vectors -----------------------------------------------------------------


def plain_components(pairs):
    at = {}

    def find(x):
        while at.setdefault(x, x) != x:
            x = at[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {x: find(x) for x in at}


def test_components(spark):
    draw = random.Random(8)
    pairs = [(k, k + 1) for k in range(60)] + [(100, 200 + k) for k in range(50)] + [(draw.randrange(300, 400), draw.randrange(300, 400)) for _ in range(60)]
    pairs = [p for p in pairs if p[0] != p[1]]
    found = components.connected_components(spark.createDataFrame([*pairs, *pairs[:9], (7, 7), (None, 3)], "a long, b long"))
    assert {r["node"]: r["component"] for r in found.collect()} == plain_components(pairs)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors(spark):
    draw = np.random.default_rng(9)
    base = draw.normal(size=(120, 32))
    near = base[:40] + 0.12 * draw.normal(size=(40, 32))
    group = base[0] + 0.05 * draw.normal(size=(60, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near, group]).astype(np.float32))]
    rows += [(900 + k, rows[1][1]) for k in range(30)] + [(800, None), (801, []), (802, [0.0] * 32), (803, [float("nan")] * 32), (804, [None] * 32), (805, rows[1][1][:16]), (None, rows[1][1])]
    found = vectors.link_vectors(spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, key int"), block=32).collect()
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and len(v) == 32 and None not in v and np.isfinite(v).all() and any(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    component = {i: i for i, _ in good} | plain_components([(good[a][0], good[b][0]) for a, b in zip(*np.nonzero(linked), strict=True)])
    wanted = {good[k][0]: (int(linked[k].sum()), component[good[k][0]]) for k in range(len(good))}
    got = {r["vec_id"]: r for r in found}
    assert len(found) == len(rows)
    assert sum(r["n_links"] for r in found) >= 0.98 * linked.sum()
    assert all(got[i]["n_links"] <= n for i, (n, _) in wanted.items())
    assert sum(got[i]["component_id"] != c for i, (_, c) in wanted.items()) <= 0.02 * len(wanted)
    for i in (800, 801, 802, 803, 804, 805):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[None]["n_links"] == 0
    assert vectors.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pivot_recall():
    draw = np.random.default_rng(10)
    x = draw.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = draw.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    pivots = vectors.pick_pivots(x[:400], 97)
    near = lambda v: np.argsort(-(v @ pivots.T), axis=1)[:, : vectors.PREFIX]
    shared = (near(x)[:, :, None] == near(y)[:, None, :]).any(2).sum(1)
    assert (shared >= vectors.SHARED).mean() >= 0.95


# -- near duplicates and passages ---------------------------------------------------------------


def edited(draw, text, times):
    w = text.split()
    for _ in range(times):
        w[draw.randrange(len(w))] = f"new{draw.randrange(10**6)}"
    return " ".join(w)


def plain_common(x, y):
    """The length of the longest common subsequence."""
    row = [0] * (len(y) + 1)
    for p in x:
        before, row = row, [0]
        for k, q in enumerate(y):
            row.append(before[k] + 1 if p == q else max(before[k + 1], row[k]))
    return row[-1]


def plain_alike(a, b, least=0.8):
    """Words shared in order, of all words of both texts."""
    x, y = words(a), words(b)
    most = sum((Counter(x) & Counter(y)).values())
    if not x or not y or most < least * (len(x) + len(y) - most) - 1e-9:
        return False
    shared = plain_common(x, y)
    return shared >= least * (len(x) + len(y) - shared) - 1e-9


def test_word_hashes(monkeypatch):
    draw = random.Random(17)
    texts = ["", "A", "é ÉA a", "..", "x" * 50, *(prose(draw, 30).title() for _ in range(20)), "a\u2028b"]
    for piece in (1 << 20, 7):
        monkeypatch.setattr(near_dup, "PIECE_BYTES", piece)
        of = {}
        for t, h in zip(texts, near_dup.word_hashes(texts), strict=True):
            assert len(h) == len(words(t))
            assert all(of.setdefault(w, x) == x for w, x in zip(words(t), h.tolist(), strict=True))
        assert len(set(of.values())) == len(of)
        for t, (_, starts, ends) in zip(texts, passages.placed_words(texts), strict=True):
            assert [t[a:b] for a, b in zip(starts, ends, strict=True)] == [w for line in t.split("\u2028") for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", line)]
    assert near_dup.word_hashes([]) == []


@pytest.mark.parametrize("block", [16])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", block)
    draw = random.Random(11)
    texts = [prose(draw, draw.randrange(80, 400), 5000) for _ in range(40)]
    texts += [edited(draw, texts[k], len(texts[k].split()) // 60) for k in range(20)]
    texts += [texts[30]] * 25 + [edited(draw, texts[31], 1) for _ in range(30)]
    common = prose(draw, 120, 5000)
    texts += [common + " " + prose(draw, 100, 5000) for _ in range(30)]
    # Copies that are alike to their base, and half of them to each other.
    base = prose(draw, 100, 5000)
    texts += [edited(draw, base, draw.choice([1, 2, 3])) for _ in range(60)]
    texts += [None, "", "a b c", "A, b; c!", "a c b", "!!", "??"]
    docs = frame(spark, texts)
    found = {r["doc_id"]: r for r in near_dup.near_duplicates(docs).collect()}
    alike = lambda a, b: (texts[a] or "") == (texts[b] or "") or plain_alike(texts[a] or "", texts[b] or "")
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if alike(a, b)]
    expected = {k: k for k in range(len(texts))} | plain_components(pairs)
    assert {i: r["cluster_id"] for i, r in found.items()} == expected
    assert {i for i, r in found.items() if r["kept"]} == set(expected.values())
    clashing = docs.withColumns({c: F.lit(1) for c in ("kept_id", "kept_content", "row", "node", "content", "keys", "n", "document")})
    kept = near_dup.drop_near_duplicates(clashing)
    assert kept.columns == clashing.columns and kept.count() == len(set(expected.values()))
    twice = docs.unionByName(docs).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    assert near_dup.drop_near_duplicates(twice).count() == len(set(expected.values()))
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0


def test_blocks_lose_no_link():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 32, 120, dtype=np.uint32)
    some = [np.concatenate([base[draw.random(120) < draw.choice([0.8, 0.9, 1.0])], draw.integers(0, 1 << 32, draw.integers(0, 25), dtype=np.uint32)]) for _ in range(40)]
    both = near_dup.shared_counts(some)
    assert all(both[i, j] == len(np.intersect1d(some[i], some[j])) for i in range(40) for j in range(i))
    for chosen in (some, some[:6]):
        n = len(chosen)
        links = [(i, j) for i in range(n) for j in range(i) if passages.jaccard(np.sort(chosen[i]), np.sort(chosen[j]), 0.8)]
        got = near_dup.links_within(chosen, np.arange(n), np.zeros(n), 0.8, None)
        assert plain_components(got) == plain_components(links)
        side = np.arange(n) % 2
        got = near_dup.links_within(chosen, np.arange(n), side, 0.8, None)
        assert plain_components(got) == plain_components([p for p in links if side[p[0]] != side[p[1]]])
    assert near_dup.links_within(some, np.zeros(40), np.zeros(40), 0.8, None) == []


def test_alignment_follows_order():
    x = np.arange(100, dtype=np.uint32)
    assert near_dup.aligned(x, x, 5) == 100
    assert near_dup.similar(x, np.delete(x, [10, 50]))
    assert not near_dup.similar(x, np.concatenate([x[50:], x[:50]]))
    s = near_dup.kmers(near_dup.word_hashes(["a b c d e a b c d e a b c d e"])[0])
    assert len(set(s.tolist())) < len(s) == len(set(near_dup.labelled(s).tolist()))


def test_alignment_equals_a_plain_table():
    draw = random.Random(23)
    for _ in range(300):
        x = np.array(draw.choices(range(draw.choice([2, 6, 40])), k=draw.randrange(30)), dtype=np.uint32)
        y = np.array([w for w in x.tolist() if draw.random() < 0.9] + draw.choices(range(6), k=draw.randrange(4)), dtype=np.uint32)
        assert near_dup.aligned(x, y, 50) == plain_common(x.tolist(), y.tolist())
        for least in (0.5, 0.8):
            shared = plain_common(x.tolist(), y.tolist())
            assert near_dup.similar(x, y, least) == (bool(len(x) and len(y)) and shared >= least * (len(x) + len(y) - shared) - 1e-9)
    # Words shifted by more than the band do not count.
    assert near_dup.aligned(np.array([1, 2, 3, 9]), np.array([9, 1, 2, 3]), 0) == 0
    assert near_dup.aligned(np.array([1, 2, 3, 9]), np.array([9, 1, 2, 3]), 1) == 3


def test_edited_texts_are_grouped(spark):
    draw = random.Random(24)
    texts = []
    for _ in range(120):
        base = prose(draw, draw.choice([60, 200, 600]), 4000)
        size = len(base.split())
        texts += [base, edited(draw, base, size * draw.choice([3, 5]) // 100)]
    long = prose(draw, 40_000, 4000)
    texts += [long, edited(draw, long, 1500), prose(draw, 40_000, 4000)]
    found = {r["doc_id"]: r["cluster_id"] for r in near_dup.near_duplicates(frame(spark, texts)).collect()}
    grouped = sum(found[2 * k] == found[2 * k + 1] for k in range(120))
    assert grouped >= 110 and found[240] == found[241] and found[242] == 242
    assert len(set(found.values())) == 122 + 120 - grouped


def test_passages(spark):
    draw = random.Random(12)
    shared = prose(draw, 60, 5000)
    texts = [f"{prose(draw, 30, 5000)}\n{shared if k < 20 else prose(draw, 40, 5000)}\nshort line" for k in range(40)]
    texts[3] = texts[3].replace(shared, edited(draw, shared, 1))
    texts += [None, "", "a\nb", "\n".join([prose(draw, 25, 5000)] * 2)]
    docs = frame(spark, texts)
    with pytest.raises(ValueError, match="at least 5 words"):
        passages.repeated_passages(docs, min_words=4)
    found = passages.repeated_passages(docs).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(20))
    assert {r["n_docs"] for r in found} == {20} and len({r["cluster_id"] for r in found}) == 1
    assert [r["doc_id"] for r in found if not r["removed"]] == [0]
    assert all(words(texts[r["doc_id"]][r["start"] : r["end"]])[:3] for r in found)
    assert all(texts[r["doc_id"]][r["start"] : r["end"]] == shared for r in found if r["doc_id"] != 3)
    assert passages.repeated_passages(frame(spark, [])).count() == 0
    bands, rows = passages.tune_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= passages.RECALL


def test_passages_inside_lines(spark):
    draw = random.Random(14)
    run, kept, wrapped, head, tail = (prose(draw, n, 5000).split() for n in (57, 45, 60, 30, 30))
    pad = lambda n: prose(draw, n, 5000).split()
    texts = [
        " ".join([*pad(88), *run, *pad(10)]),  # a 57-word run inside a line of 155 words
        " ".join([*pad(40), *run, *pad(43)]),  # and inside one of 140
        "\n".join(" ".join(wrapped[k : k + 12]) for k in range(0, 60, 12)),  # lines too short to count
        "\u2028".join(" ".join(wrapped[k : k + 15]) for k in range(0, 60, 15)),
        " ".join(kept),
        " ".join(kept),
        " ".join([*pad(50), *kept, *pad(50)]),  # as a line elsewhere
        " ".join(tail),
        " ".join([*pad(60), *head, *tail, *pad(60)]),  # the tail stands before, the head does not
        " ".join([*pad(60), *head, *tail, *pad(60)]),
        " ".join(pad(200)),
    ]
    found = passages.repeated_passages(frame(spark, texts)).collect()
    of = lambda i: sorted((r for r in found if r["doc_id"] == i), key=lambda r: r["start"])
    for a, b, shared in [(0, 1, run), (2, 3, wrapped)]:
        [x], [y] = of(a), of(b)
        assert x["cluster_id"] == y["cluster_id"] and x["n_docs"] == y["n_docs"] == 2 and not x["removed"] and y["removed"]
        for r in (x, y):
            inside = words(texts[r["doc_id"]][r["start"] : r["end"]].replace("\u2028", " "))
            assert len(inside) == r["n_words"] >= len(shared) - 2 * (passages.STEP - 1) and " ".join(inside) in " ".join(shared)
    assert len({r["cluster_id"] for i in (4, 5, 6) for r in of(i)}) == 1
    assert [[r["removed"] for r in of(i)] for i in (4, 5, 6)] == [[False], [True], [True]]
    assert not of(7)[0]["removed"] and [r["removed"] for r in of(8)] == [False, True] and {r["removed"] for r in of(9)} == {True}
    assert not of(10)
