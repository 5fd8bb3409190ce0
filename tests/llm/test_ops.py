"""Each operator on small tables: against a plain version of itself, and on nulls, empties, ties and repeats."""

import hashlib
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from tesserae.llm import embed_dedup, langid, license_scan, near_dedup, packing, quality, queries, secret_scan, token_count, trie_bpe, warc
from tesserae.llm.common import tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "The the cat."), (2, None), (3, ""), (4, "   \n\t "), (5, "é" * 300), (6, "x" * 70_000 + "  " + "abc " * 30_000), (7, "日本語 <|endoftext|> \x85 İ ΣΑΣ"),
    (7, "repeated row"), (7, "repeated row"), (None, "no id at all"), (9, "a"), (10, "password=Tr0ub4dor&3xyz AKIAABCDEFGHIJKL " + "0123456789abcdef" * 2),
]
ROWS = len(ODD)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en" if t else None, "src", 1, 2.5) for i, t in ODD], "doc_id long, text string, lang string, source string, n_tokens long, kept double")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.select("doc_id", "text").collect()}


PER_ROW = {"count": token_count.token_counts, "bpe": trie_bpe.encode, "secrets": secret_scan.scan, "quality": quality.rules, "language": langid.predict, "near": near_dedup.classes_of}


@pytest.mark.parametrize("name", PER_ROW)
def test_odd_and_empty_tables(odd, name):
    got = PER_ROW[name](odd)
    assert got.count() == ROWS
    assert got.where("doc_id is null").count() == 1 and got.where("doc_id = 7").count() == 3
    assert PER_ROW[name](odd.limit(0)).count() == 0


def test_odd_and_empty_other_tables(spark, odd):
    assert license_scan.scan(odd).count() == 0 and license_scan.scan(odd.limit(0)).count() == 0
    assert packing.pack(odd.limit(0)).count() == 0 and packing.pack(odd).where("start = 0").count() == ROWS
    pages = spark.createDataFrame([(1, None, None), (2, "u v", "x" * 2000), (3, "w", "x" * 2000), (None, "n", "x" * 2000), (4, "", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.roundtrip(pages).collect()}
    assert len(got) == 5 and got[2]["record_type"] == "revisit" and got[2]["refers_to"] == 3 and got[3]["record_type"] == "response"
    assert got[1]["payload_bytes"] == 0 and got[None]["record_type"] == "response" and warc.roundtrip(pages.limit(0)).count() == 0
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0, 0.0]), (8, [0.0, 1.0]), (9, [1.0])], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(vectors).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 7: (2, 1, False)} | {i: (0, i, True) for i in (3, 4, 5, 6, 8, 9)}
    assert embed_dedup.near_duplicates(vectors.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.SQL[name]).df()
    columns = sorted(got.columns)
    plain = lambda f: sorted(str([None if pd.isna(v) else int(v) if isinstance(v, float) else v for v in r]) for r in f[columns].astype(object).values.tolist())
    assert sorted(want.columns) == columns and plain(got) == plain(want)


def test_token_counts_equal_the_library(docs, odd):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for frame in (docs, odd):
        want = sorted((i or -1, len(own.encode(t or ""))) for i, t in frame.select("doc_id", "text").collect())
        assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in token_count.token_counts(frame).collect()) == want


def test_bpe_equals_the_library(docs, odd):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for frame in (docs, odd):
        want = []
        for i, t in frame.select("doc_id", "text").collect():
            ids = own.encode(t or "", add_special_tokens=False).ids
            want.append((i or -1, hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert sorted((r["doc_id"] or -1, r["ids_sha256"], r["decoded_sha256"]) for r in trie_bpe.encode(frame).collect()) == sorted(want)


def test_packing_is_whole_and_tight(docs, odd):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    known, got = texts(docs), packing.pack(docs).toPandas()
    for i, pieces in got.sort_values("piece").groupby("doc_id"):
        ids = np.array([*own.encode(known[i], add_special_tokens=False).ids, 2], dtype="<u4")
        assert list(pieces["start"]) == [0, *np.cumsum(pieces["length"])[:-1]] and pieces["length"].sum() == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(pieces["start"], pieces["length"], pieces["ids_crc32"], strict=True))
        assert len(ids) > 1024 or len(pieces) == 1
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["length"].sum() <= 1024 and list(s["offset"]) == [0, *np.cumsum(s["length"])[:-1]]
    full = packing.pack(odd).toPandas()
    assert all(s["length"].sum() <= 1024 for _, s in full.groupby("sequence_id"))


def test_packing_plan():
    assert packing.fullest({7: 1, 5: 2, 3: 1}, 10) == [7, 3]
    assert packing.fullest({6: 3, 4: 1}, 9) == [6]
    rng = np.random.default_rng(1)
    lengths = np.minimum(1024, rng.lognormal(6, 1, 20_000).astype(int) + 1)
    counts = dict(zip(*map(lambda x: x.tolist(), np.unique(lengths, return_counts=True)), strict=True))
    bins = packing.plan(counts, 1024)
    used = {}
    for times, own in bins:
        assert sum(own) <= 1024
        for x in own:
            used[x] = used.get(x, 0) + times
    assert used == counts and sum(n for n, _ in bins) <= 1.01 * -(-int(lengths.sum()) // 1024)


def test_secret_spans():
    got = secret_scan.spans('x token = "abcdefgh" y AKIAABCDEFGHIJKL secret:short ' + "0a" * 16 + " pwd: hunter2hunter9Z!x", 10.0)
    assert [k for _, _, k in got] == ["assign", "access", "hex", "guess"]
    assert secret_scan.spans("the password is correct and the token is old", 10.0) == []
    assert secret_scan.segments("password")[0] < 3 < 10 < secret_scan.segments("Zx9#qL2!vB")[0]
    assert {s[0] for s in secret_scan.segments("qwertyuiop1999-01-31aaaaaa")[1]} >= {"walk", "date", "repeat"}


def test_secret_of_any_length():
    rng = np.random.default_rng(4)
    jwt = "".join(rng.choice(list("abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNP23456789-_."), 599)) + "Q"
    text = "Authorization: Bearer " + jwt + " end"
    assert secret_scan.spans(text, 10.0) == [(22, 622, "guess")]
    assert secret_scan.spans("pwd: " + "g" * 60_000, 10.0) == []
    assert secret_scan.spans("pwd: " + "g" * 60_000 + jwt, 10.0) == [(5, 60_605, "guess")]


def test_secrets_of_letters():
    ranked = secret_scan.ranks(tokenizer_path("piece_bpe_32k.model"))
    for text in ("pwd: kXvQzRtPwLmNbHsYcD", "passphrase = QmZrTxKvBnWpLs", "the password is kXvQzRtPwLmNbHs", "pwd: kxvqzrtpwlmnbhs", "passphrase: xQvBnZkLpWrTmHs"):
        assert secret_scan.spans(text, 10.0, ranked) == [(text.rindex(" ") + 1, len(text), "guess")]
    for text in ("the password is required, passphrase: correcthorse", "pwd: iloveyou2024", "the token is available", "passcode: P@ssw0rd2024!"):
        assert secret_scan.spans(text, 10.0, ranked) == []


def test_guess_cost_against_brute_force():
    rng, ranked = np.random.default_rng(12), secret_scan.ranks(tokenizer_path("piece_bpe_32k.model"))
    cut = np.log10(2)

    def priced(value, a, b):
        """The kinds of one segment, spelled out; walks and dates do not come up in these values."""
        part, one = value[a:b], np.log10(max(secret_scan._alphabet(value), 10))
        out = [one * (b - a)]
        if part in ranked[0]:
            out.append(np.log10(ranked[0][part] + 1) + (cut if a == 0 else cut))
        for period in range(1, 5):
            if b - a >= max(3, 2 * period) and all(part[i] == part[i - period] for i in range(period, b - a)):
                out.append(one * period + np.log10((b - a) / period) + cut)
        return out

    for _ in range(60):
        value = "".join(rng.choice(["the", "cat", "q", "zq", "bb", "bbb"], rng.integers(1, 4)))
        n, one = len(value), np.log10(max(secret_scan._alphabet(value), 10))
        # states: the cost of a cut up to a place, whether its last segment is brute force
        best = {(0, None): 0.0}
        for b in range(1, n + 1):
            for a in range(b):
                for last in (None, True, False):
                    if (a, last) in best:
                        brute = best[a, last] + one * (b - a) + (cut if last is False else 0)
                        best[b, True] = min(best.get((b, True), np.inf), brute)
                        for price in priced(value, a, b)[1:]:
                            best[b, False] = min(best.get((b, False), np.inf), best[a, last] + price)
        assert secret_scan.segments(value, dictionary=ranked)[0] == pytest.approx(min(best[n, k] for k in (True, False) if (n, k) in best), abs=0.31)


def test_secret_base_columns(docs, odd):
    """Counts against SQL, the digest against a scan character by character."""
    con = duckdb.connect()
    letters = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")

    def runs(text, alphabet, least, first=""):
        out, i = [], 0
        while i < len(text):
            if text.startswith(first, i) and text[i] in alphabet:
                j = i
                while j < len(text) and text[j] in alphabet:
                    j += 1
                if j - i >= least:
                    out.append((i, j))
                i = max(j, i + 1)
            else:
                i += 1
        return out

    def assigns(text):
        out, i, low = [], 0, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        while i < len(text):
            name = next((k for k in ("password", "passwd", "secret", "token", "api_key", "apikey") if low.startswith(k, i)), None)
            end = None
            if name:
                j = i + len(name)
                j += text[j : j + 1] in ("'", '"')
                while text[j : j + 1] == " ":
                    j += 1
                if text[j : j + 1] in (":", "=") and text[j : j + 1]:
                    j += 1
                    while text[j : j + 1] == " ":
                        j += 1
                    j += text[j : j + 1] in ("'", '"')
                    end = j
                    while end < len(text) and text[end] in letters:
                        end += 1
            if end and end > j:
                if end - j >= 8:
                    out.append((i, end))
                i = end
            else:
                i += 1
        return out

    def access(text):
        out, i = [], text.find("AKIA")
        while i >= 0:
            j = i + 4
            while j < len(text) and (text[j] in "0123456789" or "A" <= text[j] <= "Z"):
                j += 1
            if j - i >= 16:
                out.append((i, j))
            i = text.find("AKIA", j if j > i + 4 else i + 1)
        return out

    for frame in (docs, odd):
        rows = [(r["doc_id"], r["text"] or "") for r in frame.select("doc_id", "text").collect()]
        want = []
        for i, t in rows:
            spans = [(a, 0, b, "assign") for a, b in assigns(t)] + [(a, 1, b, "access") for a, b in access(t)] + [(a, 2, b, "hex") for a, b in runs(t, set("0123456789abcdef"), 32)]
            digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)).encode()).hexdigest()
            want.append((-1 if i is None else i, *[sum(s[1] == k for s in spans) for k in range(3)], digest))
        got = secret_scan.scan(frame).toPandas()
        assert sorted((-1 if pd.isna(r.doc_id) else int(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got.itertuples()) == sorted(want)
        texts_ = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
        counts = con.execute(r"""SELECT doc_id, len(list_filter(regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda v: len(v) >= 8)) AS a,
            len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda v: len(v) >= 16)) AS b, len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda v: len(v) >= 32)) AS c FROM texts_""").fetchall()
        assert sorted((-1 if i is None or i != i else int(i), a, b, c) for i, a, b, c in counts) == sorted(w[:4] for w in want)


def test_secret_hint_is_no_filter():
    for name in ("accessKey", "privatekey", "access-key", "private_key", "api-key", "apikey", "secretkey", "authkey", "pwd", "passcode", "bearer", "credentials"):
        assert [k for _, _, k in secret_scan.spans(name + " = Zx9#qL2!vBw81", 10.0)] == ["guess"]


def test_secret_context_in_long_names():
    """A name's parts are not searched anew from each of them: a long chain of parts takes no time."""
    for name in ("db-pwd", "MY_APP-auth_key", "x" * 50_000 + "_passphrase", "a-" * 200_000 + "pwd"):
        text = name + " = Zx9#qL2!vBw81"
        assert secret_scan.spans(text, 10.0) == [(len(name) + 3, len(text), "guess")]
    began = time.perf_counter()
    assert secret_scan.spans("pwd " + "a-" * 400_000, 10.0) == []
    assert time.perf_counter() - began < 5


def test_secret_values_past_base_spans(spark):
    import corpus_pipeline

    text = "x password=Tr0ub4dor&3xyz$Q9 y token=abcdefgh z"
    assert secret_scan.spans(text, 10.0) == [(2, 20, "assign"), (11, 28, "guess"), (31, 45, "assign")]
    out = corpus_pipeline.secret_scans(spark, spark.createDataFrame([(1, text)], "doc_id long, text string"), SF).first()
    assert out["text"] == "x [SECRET] y [SECRET] z" and out["n_chars"] == len(out["text"])


def test_secret_redaction(odd):
    got = {r["doc_id"]: r["redacted"] for r in secret_scan.scan(odd.where("doc_id = 10 or doc_id = 2"), redact="[S]").collect()}
    assert got[2] is None and got[10] == "[S] [S] [S]"


def test_repeated_words_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        words = [str(x) for x in rng.integers(0, 2, rng.integers(0, 60))]
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
        assert quality.repeated_words(words) == len(hit)


def test_quality_of_the_last_bytes():
    import zstandard

    rng = np.random.default_rng(7)
    prose = lambda n: (" ".join(f"{w}{k % 9}" for k, w in enumerate(rng.choice([f"word{i}" for i in range(600)], n))) + " ").ljust(n)[:n]
    noise = lambda n: "".join(rng.choice([chr(c) for c in range(1, 128) if not 9 <= c <= 13 and c != 32], n))
    fields = dict(zip((f.split()[0] for f in quality.MEASURES.split(", ")), quality.measure(prose(4096) + noise(4096) + noise(4000), zstandard.ZstdCompressor(level=quality.LEVEL)), strict=True))
    assert (fields["n_chunks"], fields["n_bad_chunks"], fields["kept"]) == (3, 2, False)
    assert quality.measure(prose(4096), zstandard.ZstdCompressor(level=quality.LEVEL))[-2:] == (0, 0)


def test_quality_counts(docs, odd):
    """All columns against SQL where it can express them, and against a plain loop."""
    import zstandard

    con = duckdb.connect()
    for frame in (docs, odd):
        rows = frame.select("doc_id", "text").toPandas()
        sql = con.execute(r"""WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM rows)
            SELECT doc_id, len(w), coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT, len(coalesce(text, '')) - len(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')), len(l) - len(list_distinct(l)) FROM w""").fetchall()
        number = lambda i: -1 if i is None or i != i else int(i)
        got = quality.rules(frame).collect()
        assert sorted((number(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) for r in got) == sorted((number(r[0]), *map(int, r[1:])) for r in sql)
        want = []
        for i, t in zip(rows["doc_id"], rows["text"], strict=True):
            words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", t or "") if w]
            windows, seen = [tuple(words[k : k + 8]) for k in range(len(words) - 7)], {}
            for x in windows:
                seen[x] = seen.get(x, 0) + 1
            hit = {k + j for k, x in enumerate(windows) if seen[x] > 1 for j in range(8)}
            failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
            raw, squeeze = (t or "").encode(), zstandard.ZstdCompressor(level=quality.LEVEL)
            parts = [raw[k : k + 4096] for k in range(0, len(raw), 4096)] if len(raw) > 4096 else []
            if parts and len(parts[-1]) < 4096:
                parts[-1] = raw[-4096:]
            bad = [p for p in parts if not quality.CHUNK_LOW <= len(squeeze.compress(p)) / len(p) <= quality.CHUNK_HIGH]
            low, high = next((lo, hi) for most, lo, hi in quality.BANDS if len(raw) <= most)
            kept = not failed and low <= len(squeeze.compress(raw)) / len(raw) <= high and len(bad) <= len(parts) / 2
            want.append((number(i), len(hit), failed, kept))
        assert sorted((number(r["doc_id"]), r["n_repeat_words"], r["base_failed"], r["kept"]) for r in got) == sorted(want)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert got.where("lang_pred = lang").count() >= 0.95 * got.count()
    assert {r["lang_pred"] for r in langid.predict(docs.limit(1).selectExpr("1L as doc_id", "'123 !' as text", "'en' as lang")).collect()} == {"und"}


def test_warc_salvage():
    page = lambda i: (b"page %d " % i) * 300
    for compress in (True, False):
        parts = [warc.record_bytes(i, "http://h/ x", page(i), hashlib.sha1(page(i)).hexdigest(), None, compress) for i in range(20)]
        at = [0, *np.cumsum([len(p) for p in parts])]
        data = bytearray(b"".join(parts))
        middle = (at[5] + at[6]) // 2
        data[middle : middle + 20] = bytes(20)
        out = list(warc.salvage(bytes(data[: at[19] + 40])))
        records, gaps = [x for x in out if isinstance(x, warc.Record)], [x for x in out if isinstance(x, warc.Gap)]
        assert [warc.fields(r)[0] for r in records] == [i for i in range(19) if i != 5]
        assert [(g.start, g.end) for g in gaps] == [(at[5], at[6]), (at[19], at[19] + 40)]
        assert all(r.payload == page(warc.fields(r)[0]) for r in records)
    assert list(warc.salvage(b"")) == [] and isinstance(list(warc.salvage(b"junk"))[0], warc.Gap)


def _revisit(**changed):
    raw = warc.record_bytes(7, "http://h/", b"x" * 1500, hashlib.sha1(b"x" * 1500).hexdigest(), 9, False).decode()
    for name, value in changed.items():
        key = name.replace("_", "-")
        raw = "\r\n".join(f"{key}: {value}" if line.startswith(key + ":") else line for line in raw.split("\r\n"))
    return raw.encode()


@pytest.mark.parametrize("bad", [{"WARC_Payload_Digest": "sha256:abcdef01"}, {"X_Payload_Length": "many"}, {"Content_Length": "²"}])
def test_warc_malformed_fields_are_gaps(bad):
    import gzip

    good = warc.record_bytes(1, "http://h/", b"y" * 50, hashlib.sha1(b"y" * 50).hexdigest(), None, False)
    for pack in (lambda b: b, gzip.compress):
        out = list(warc.salvage(pack(good) + pack(_revisit(**bad)) + pack(good)))
        assert [isinstance(x, warc.Gap) for x in out] == [False, True, False]
        assert [warc.fields(x)[0] for x in out if isinstance(x, warc.Record)] == [1, 1]


def test_warc_payload_that_quotes_a_record():
    quoted = warc.record_bytes(999, "http://q/", b"q" * 40, hashlib.sha1(b"q" * 40).hexdigest(), None, False)
    outer = warc.record_bytes(5, "http://h/", b"before" + quoted + b"after", "0" * 40, None, False)  # a wrong digest
    good = warc.record_bytes(6, "http://h/", b"z" * 40, hashlib.sha1(b"z" * 40).hexdigest(), None, False)
    for tail in (good, b""):
        out = list(warc.salvage(outer + tail))
        assert (out[0].start, out[0].end) == (0, len(outer)) and [warc.fields(r)[0] for r in out[1:]] == ([6] if tail else [])
    import gzip
    import os

    inner = gzip.compress(quoted)
    member = bytearray(gzip.compress(warc.record_bytes(5, "http://h/", os.urandom(3000) + inner + os.urandom(3000), "0" * 40, None, False), 0))
    member[-6] ^= 1  # the checksum
    out = list(warc.salvage(bytes(member) + gzip.compress(good)))
    assert (out[0].start, out[0].end) == (0, len(member)) and [warc.fields(r)[0] for r in out[1:]] == [6]


def test_warc_clashing_columns_and_repeats(spark):
    rows = [(1, "u", "x" * 1200, "g", 5), (1, "u", "x" * 1200, "g", 5), (2, "u", "x" * 1200, "g", 5), (2, "v", "x" * 1200, "g", 5), (3, "w", "short", "g", 5), (3, "w", "short", "g", 5)]
    got = warc.roundtrip(spark.createDataFrame(rows, "page_id long, url string, html string, digest string, last int")).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == [(1, "revisit", 2)] * 2 + [(2, "response", None)] * 2 + [(3, "response", None)] * 2


def test_pairs_missed_by_all_trees(spark):
    rng, pairs = np.random.default_rng(6), 10_000
    a = rng.integers(-(2**31), 2**31, (pairs, near_dedup.COORDINATES))
    b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(-(2**31), 2**31, a.shape))
    rows = [(b"%d" % k, 100, x, 0, 0) for k, x in enumerate(np.concatenate([a, b]).tolist())]
    classes = spark.createDataFrame(rows, near_dedup.SKETCHED)
    nodes = near_dedup.tree_nodes(classes, near_dedup.Scratch(spark, "trees"), limit=1)  # all pairs go four deep
    met = nodes.selectExpr("node", f"cast(cast(sid as string) as int) % {pairs} as pair").groupBy("node", "pair").count().where("count > 1").select("pair").distinct().count()
    assert pairs - met <= 8  # 0.0002 of them are expected, about 2


def test_near_duplicates_of_many_copies(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base[:j] + [f"z{i}"] + base[j + 1 :])) for i, j in enumerate(rng.integers(0, 300, 150).tolist())] + [(1000 + i, " ".join(f"q{i}x{k}" for k in range(60))) for i in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.classes_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in range(150)) and all(got[1000 + i] == 1000 + i for i in range(60))


def test_near_duplicates_of_large_nodes_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(80)]
    edited = lambda k: [f"e{rng.integers(1_000_000)}" if j in at else w for at in [set(rng.choice(80, k, replace=False).tolist())] for j, w in enumerate(base)]
    rows = [(i, " ".join(edited(int(k)))) for i, k in enumerate(rng.integers(2, 14, 160).tolist())]
    sets = {i: near_dedup.shingle_set(t) for i, t in rows}
    lowest = {i: i for i in sets}
    for _ in range(len(sets)):
        before = dict(lowest)
        for i, x in sets.items():
            for j, y in sets.items():
                if 100 * len(x & y) >= 80 * len(x | y):
                    lowest[i] = min(lowest[i], lowest[j])
        if lowest == before:
            break
    # nodes of more than four classes stay large, and their blocks hold a few sets each
    monkeypatch.setattr(near_dedup, "BLOCK", 1500)
    monkeypatch.setattr(near_dedup.tree_nodes, "__defaults__", (near_dedup.TREES, near_dedup.LEVELS, 4))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.classes_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == lowest and 1 < len(set(lowest.values())) < 160


def _groups_of_groups(groups: int, size: int) -> list:
    """Vectors of unit length: groups of that size, whose members are far nearer to each other than to other groups."""
    rng = np.random.default_rng(8)
    centres = np.eye(groups + 1)[0] + 0.16 * np.eye(groups + 1)[1:]
    return (np.repeat(centres, size, axis=0) + rng.normal(0, 0.002, (groups * size, groups + 1))).tolist()


def _linked_by_force(x, threshold=0.95):
    """(n_links, component) of each row of x, by all pairs and a search over them."""
    x = np.asarray(x) / np.sqrt((np.asarray(x) ** 2).sum(axis=1))[:, None]
    near = [np.flatnonzero(r >= threshold) for r in x @ x.T]
    least = [-1] * len(x)
    for i in range(len(x)):
        todo = [i] if least[i] < 0 else []
        while todo:
            j = todo.pop()
            if least[j] < 0:
                least[j] = i
                todo += near[j].tolist()
    return {i: (len(near[i]) - 1, least[i]) for i in range(len(x))}


def test_embedding_twin_groups(spark):
    """300 pairs of tight groups of ten, linked across a pair, and random clusters; nothing is missed."""
    rng = np.random.default_rng(21)
    base = rng.normal(size=(300, 48))
    base /= np.sqrt((base * base).sum(axis=1))[:, None]
    side = rng.normal(size=(300, 48))
    side -= (side * base).sum(axis=1)[:, None] * base
    side /= np.sqrt((side * side).sum(axis=1))[:, None]
    twins = np.concatenate([base, base * 0.967 + side * np.sqrt(1 - 0.967**2)])
    rows = np.repeat(twins, 10, axis=0) + rng.normal(0, 0.002, (6000, 48))
    clusters = np.repeat(rng.normal(size=(40, 48)), 15, axis=0) + rng.normal(0, 0.16, (600, 48))
    x = np.concatenate([rows, clusters])
    vectors = spark.createDataFrame([(i, v, i % 7, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int, component_id int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(vectors).collect()}
    want = _linked_by_force(x)
    assert sum(n for n, _ in want.values()) > 110_000 and got == want


def test_embedding_signed_zeros_ties_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, -0.0]), (3, [1.0, 0.01]), (3, [1.0, 0.01]), (4, [-1.0, -0.0]), (5, [-1.0, 0.0]), (6, [0.0, 1.0]), (6, [0.0, -1.0])]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (3, 3, 1, False), (4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True), (6, 0, 6, True)]


def test_embedding_links_between_tight_groups(spark, monkeypatch):
    near = _groups_of_groups(12, 12)
    far = np.random.default_rng(9).normal(size=(300, 13)).round(3).tolist()
    x = np.array([*near, *far])
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    sims = x @ x.T
    assert sims[:144, :144].min() >= 0.97
    linked = sims >= 0.95
    reach = np.linalg.matrix_power(linked.astype(float), 64) > 0
    want = {i: (int(linked[i].sum()) - 1, int(np.flatnonzero(reach[i])[0])) for i in range(len(x))}
    monkeypatch.setattr(embed_dedup, "AUDIT", 0)  # no audited class lies in the group
    vectors = spark.createDataFrame(list(enumerate([*near, *far])), "vec_id long, embedding array<double>")
    found = lambda: {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(vectors).collect()}
    assert want[143] == (143, 0) and found() == want
    monkeypatch.setattr(embed_dedup, "_joins_in_leaves", lambda *a: spark.createDataFrame([], "a binary, b binary"))
    assert found() == want  # the exact step finds all by itself as well


def test_embedding_recall_below_target_compares_all(spark, monkeypatch):
    x = np.random.default_rng(10).normal(size=(60, 2))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    linked = x @ x.T >= 0.9999
    reach = np.linalg.matrix_power(linked.astype(float), 64) > 0
    want = {i: (int(linked[i].sum()) - 1, int(np.flatnonzero(reach[i])[0])) for i in range(60)}
    empty = lambda *a: spark.createDataFrame([], embed_dedup.EDGE)
    monkeypatch.setattr(embed_dedup, "_leaves", empty)
    monkeypatch.setattr(embed_dedup, "AUDIT", 20)
    vectors = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(vectors, 0.9999).collect()}
    assert got == want and len({c for _, c in got.values()}) < 60


def test_language_edges(spark):
    rows = [(1, "the cat sat on the mat", "en"), (3, "²½①Ⅷ 12", "en"), (4, None, None), (5, "日本", "en"), (5, "日本", "en"), (6, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(3))
    got = sorted((r["doc_id"], r["lang_pred"]) for r in langid.predict(docs).collect())
    assert got == [(1, "en"), (3, "und"), (4, "und"), (5, "en"), (5, "en"), (6, "und")]
    assert {r["lang_pred"] for r in langid.predict(docs.drop("lang")).collect()} == {"und"}
    net = langid.ByteCNN(["a", "b"])
    net.out[:] = 0
    assert net.predict(["tie"]) == [("a", 0.5)]


def test_convolution_and_gradient_against_loops():
    net, rng = langid.ByteCNN(["a", "b", "c"], seed=3), np.random.default_rng(3)
    x, y = rng.integers(0, 256, (3, langid.WINDOW)).astype(np.uint8), np.array([0, 2, 1])

    def logits(net, row):
        tops = []
        for w in net.conv:
            n = langid.WINDOW - len(w) + 1
            tops += [max(sum(float(w[k, row[i + k], f]) for k in range(len(w))) for i in range(n)) for f in range(langid.FILTERS)]
        return np.maximum(np.array(tops) + net.bias, 0) @ net.out + net.shift

    loss = lambda net: float(np.mean([np.log(np.exp(z - z.max()).sum()) + z.max() - z[c] for z, c in ((logits(net, r), c) for r, c in zip(x, y, strict=True))]))
    tops, _ = net.pool(x, net.tables())
    assert np.allclose(np.maximum(tops + net.bias, 0) @ net.out + net.shift, [logits(net, r) for r in x], atol=1e-4)
    before = loss(net)
    net.train(x, y, epochs=3, rate=0.001)
    assert loss(net) < before


def test_license_index_of_any_size(docs, odd, monkeypatch):
    held = docs.where("text ilike '%license%' or doc_id < 20")
    frames = [odd, held.union(held)]
    want = [sorted(map(tuple, license_scan.scan(f).collect())) for f in frames]
    monkeypatch.setattr(license_scan, "LITERAL_KEYS", 0)
    assert [sorted(map(tuple, license_scan.scan(f).collect())) for f in frames] == want and len(want[1]) > 0 == len(want[0])


def test_packing_in_shares(docs, monkeypatch):
    places = lambda: sorted((r["length"], r["sequence_id"], r["offset"]) for r in packing.pack(docs).collect())
    want = places()
    monkeypatch.setattr(packing, "SHARE", 7)
    assert places() == want


def test_near_duplicate_ties_and_repeats(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text, 1), (5, text, 1), (2, text.upper(), 1), (9, text + " x", 1), (None, text, 1), (7, "one", 1), (8, "one", 1), (1, "", 1)]
    got = near_dedup.classes_of(spark.createDataFrame(rows, "doc_id long, text string, component_id int")).collect()
    key = lambda r: (r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"])
    assert sorted(map(key, got)) == [(-1, 29, 2, False), (1, 0, 1, True), (2, 29, 2, True), (5, 29, 2, False), (5, 29, 2, False), (7, 1, 7, True), (8, 1, 7, False), (9, 30, 2, False)]


def test_license_templates_and_edits(spark):
    rows = [(i, "zz " * 40 + t.upper() + " yy" * 9) for i, (_, t) in enumerate(license_scan.TEMPLATES)] + [(99, license_scan.TEMPLATES[9][1].replace("granted", "given"))]
    got = {(r["doc_id"], r["license_id"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(i, k) for i, (k, _) in enumerate(license_scan.TEMPLATES)} <= got and (99, license_scan.TEMPLATES[9][0]) in got


def test_pipeline(spark, docs, odd):
    import corpus_pipeline

    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, SF)
        if name != "best-fit packing":
            assert out.columns == list(corpus_pipeline.COLUMNS) and 0 < out.count() <= kept.count()
            kept = out
    ids = {r["doc_id"] for r in out.collect()}
    assert ids == {r["doc_id"] for r in kept.collect()} 
    assert all(not secret_scan.spans(t, 10.0) for t in texts(kept).values())
    stages = dict(corpus_pipeline.STAGES)
    for frame in (odd, odd.select("doc_id", "text")):
        ids = {name: sorted(r["doc_id"] or -1 for r in stage(spark, frame, SF).collect()) for name, stage in stages.items()}
        assert set(ids["language ID"]) <= {-1, 1, 5, 6, 7, 9, 10} and (ids["language ID"] == [] or "lang" in frame.columns)
        assert ids["quality rules"] == []  # too short, or one word over and over
        assert ids["MinHash near-dedup"] == [-1, 1, 2, 3, 4, 5, 6, 7, 7, 9, 10]  # of the repeated rows one stays
        assert ids["secret scans"] == [-1, 1, 2, 3, 4, 5, 6, 7, 7, 7, 9, 10]
        assert sorted(set(ids["best-fit packing"])) == [-1, 1, 2, 3, 4, 5, 6, 7, 9, 10] and len(ids["best-fit packing"]) > ROWS
        hidden = {r["doc_id"]: r["text"] for r in stages["secret scans"](spark, frame, SF).collect()}
        assert hidden[10] == "[SECRET] [SECRET] [SECRET]" and hidden[2] is None and hidden[1] == "The the cat."
    for name, stage in stages.items():
        assert stage(spark, odd.limit(0), SF).count() == 0, name


def test_members_of_hubs_against_single_comparisons():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    seats = [(h, int(m)) for h, size in enumerate((1, 2, 5, 17, 17, 9)) for m in rng.choice(40, size, replace=False)]
    seats = [seats[i] for i in rng.permutation(len(seats))]
    hub, member = zip(*seats, strict=True)
    floor = np.where(np.arange(40) % 2, 0.1, -2.0)
    got = pd.concat(embed_dedup._around_hubs(pd.Series(hub), np.array(member), x[list(member)], floor[list(member)]))
    want = []
    for h, m in seats:
        others = sorted(((float(x[m] @ x[o]), o) for g, o in seats if g == h and o != m), reverse=True)
        want += [(m, o) for sim, o in others[: embed_dedup.K] if sim > floor[m]]
    assert sorted(zip(got["cid"], got["other"], strict=True)) == sorted(want)
    assert np.allclose(got["sim"], [x[a] @ x[b] for a, b in zip(got["cid"], got["other"], strict=True)])
