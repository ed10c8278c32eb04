import hashlib
import random

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from mapforge.llm import bpe, fingerprint, rules, simhash, warc

from .cases import frame, messy, texts


def test_bucket_digest_against_plain(spark):
    rows = texts()
    got = {r.doc_id: r for r in fingerprint.edited_comparison(frame(spark, rows)).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for (i, t), (_, follow) in zip(order, order[1:] + order[:1]):
        t, follow = t or "", follow or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + follow[:k]
        r = got[i]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fingerprint.digest(t.encode())
        assert r.near_edited == fingerprint.likeness(r.fingerprint, fingerprint.digest(edited.encode()))
        assert r.near_next == fingerprint.likeness(r.fingerprint, fingerprint.digest(follow.encode()))
        assert 0 <= r.near_edited <= 1


def test_bucket_digest_edges(spark):
    rows = messy(texts())
    assert fingerprint.edited_comparison(frame(spark, rows)).count() == len(rows)
    assert fingerprint.edited_comparison(frame(spark, [])).count() == 0
    one = fingerprint.edited_comparison(frame(spark, [(7, "abcdef")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert fingerprint.digest(b"a" * 3_000_000) != fingerprint.digest(b"a" * 30)
    whole = bytes(random.Random(1).choices(range(256), k=3 << 20))
    step, fingerprint.STEP = fingerprint.STEP, 1000
    try:
        stepped = fingerprint.digest(whole)
    finally:
        fingerprint.STEP = step
    assert stepped == fingerprint.digest(whole)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark):
    rng = random.Random(3)
    big = "".join(rng.choice("<p>é漢 \r\n") for _ in range(60_000))
    rows = [(i, f"http://x/{i}", "".join(rng.choice("ab<>é\r\n\r\n") for _ in range(rng.randint(0, 3000)))) for i in range(50)]
    rows += [(100, "u", big), (101, "u", big), (102, None, None), (103, "", ""), (104, "a\r\nb", "WARC/1.1\r\n\r\n0\r\n\r\n"), (105, "u", "same"), (99, "u", "same"), (98, "u", "same")]
    got = {r.page_id: r for r in warc.archive_round_trip(pages(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        payload = (html or "").encode()
        top = max(j for j, _, h in rows if (h or "").encode() == payload)
        assert got[i].payload_bytes == len(payload)
        assert got[i].payload_digest == warc.payload_digest(payload)
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if top == i else ("revisit", top))


def test_warc_edges(spark):
    big = "z" * 100_000
    rows = [(1, "u", big), (1, "u", big), (1, "v", "other"), (None, "u", big), (None, "u", "lone"), (2, None, None)]
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type) for r in warc.archive_round_trip(pages(spark, rows)).collect())
    assert got == sorted([(1, 100_000, "response")] * 2 + [(1, 5, "response"), (0, 100_000, "revisit"), (0, 4, "response"), (2, 0, "response")])
    assert warc.archive_round_trip(pages(spark, [])).count() == 0
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"3\r\nab", b"zz\r\n", b"5\r\nabcde\r\n"):
        with pytest.raises(warc.WarcError):
            warc.dechunked(bad)


def test_warc_reads_gzip_members_in_pieces():
    import gzip

    blocks = [bytes([i]) * n for i, n in enumerate((0, 10, 70_000, 3))]
    data = b"".join(gzip.compress(warc._record([("WARC-Type", "response")], b) + b"\r\n\r\n") for b in blocks)
    assert [b for _, b in warc.parse(warc._gunzipped(data, 100))] == blocks
    with pytest.raises(warc.WarcError):
        list(warc.parse(warc._gunzipped(data[:-20])))


def test_warc_segments_must_be_whole(spark, tmp_path):
    found = list(warc.records(1, "u", b"q" * 50_000, None, False, 16 << 10))
    assert len(found) == 4
    for keep in ([0, 1, 3], [1, 2, 3], [0, 1, 2]):
        where = tmp_path / "-".join(map(str, keep))
        where.mkdir()
        (where / "a.warc").write_bytes(b"".join(found[i] + b"\r\n\r\n" for i in keep))
        with pytest.raises(Exception, match="WarcError"):
            warc.read_archives(spark, f"file://{where}").collect()
    where = tmp_path / "shuffled"
    where.mkdir()
    (where / "a.warc").write_bytes(b"".join(found[i] + b"\r\n\r\n" for i in (2, 0, 3, 1)))
    assert [r.payload_bytes for r in warc.read_archives(spark, f"file://{where}").collect()] == [50_000]


def plain_measures(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)} if len(words) < 3000 else None
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), covered and len(covered) or 0


def test_rule_ledger(spark):
    rows = [*texts(), (2000, "# $ a\n\na\n a\na #|<>"), (2001, "a b c a b c a b")]
    got = {r.doc_id: r for r in rules.judged(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r, want = got[i], plain_measures(t)
        if len((t or "").split()) < 3000:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
        assert r.kept == (r.failed_bits == 0)
    assert rules.judged(frame(spark, messy(rows))).count() == len(messy(rows))
    assert rules.judged(frame(spark, [])).count() == 0


def test_repeat_words_with_many_distinct_words(monkeypatch):
    words = [b"%d" % (i % 5000) for i in range(9000)]
    want = rules._repeat_words(words)
    big = words + [b"u%d" % i for i in range(1 << 21)]
    assert rules._repeat_words(big) == want


def test_rule_ablation(spark):
    entries = rules.ledger(frame(spark, texts()))
    got = {r.rule: (r.n_failed, r.n_only) for r in rules.ablation(entries).collect()}
    bits = [r.failed_bits for r in entries.collect()]
    for r in rules.RULES:
        n = sum(b >> r.bit & 1 for b in bits)
        if n:
            assert got[r.name] == (n, sum(b == 1 << r.bit for b in bits))
    v1 = rules.apply_policy(entries, "v1").where("kept").count()
    assert v1 == sum(not b & rules.POLICIES["v1"] for b in bits)


def test_bpe_matches_the_library(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    odd = "ab the  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　éß漢😀'sdlm'12½٣_-.!‍﻿\x00\x7f"
    rows = [(i, "".join(rng.choice(odd) for _ in range(rng.randint(0, 80)))) for i in range(400)]
    rows += [*((5000 + i, t) for i, t in texts() if i is not None), (9000, "x<|endoftext|><|endoftext|> y"), (9001, "the" * 3000), (9002, None), (9003, " " * 5000)]
    lib = Tokenizer.from_file(bpe.default_vocabulary()[0])
    got = {r.doc_id: r for r in bpe.round_trip(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(raw).hexdigest()), i
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(frame(spark, [])).count() == 0
    assert bpe.round_trip(frame(spark, messy(rows))).count() == len(messy(rows))


def test_bpe_long_text(monkeypatch):
    b = bpe.Bpe(*bpe.default_vocabulary())
    text = "hello there <|endoftext|> " * 200
    want = b.encode_batch([text])
    monkeypatch.setattr(bpe, "LONG", 100)
    assert b.encode_batch([text, "a", text]) == [want[0], b.encode_batch(["a"])[0], want[0]]


def plain_simhash(text):
    import re

    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def linked(values, max_bits=2):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = sorted(parent)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= max_bits:
                parent[find(a)] = find(b)
    return {v: find(v) for v in values}


def test_simhash_against_plain(spark):
    rows = texts(n=200)
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    fps = {i: plain_simhash(t) for i, t in rows}
    root = linked(fps.values())
    assert len(got) == len(rows)
    for i, _ in rows:
        assert got[i].fingerprint == f"{fps[i]:016x}"
        assert got[i].component_id == min(j for j in fps if root[fps[j]] == root[fps[i]])


def test_simhash_links_and_chains(spark):
    rng = random.Random(9)
    values = {rng.getrandbits(64) for _ in range(150)}
    for v in list(values)[:60]:
        for _ in range(4):
            v ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    ids = list(range(len(signed)))
    rng.shuffle(ids)
    fps = spark.createDataFrame(list(zip(ids, signed)) + [(None, signed[0])], "doc_id long, fp long")
    pairs = {(r.a, r.b) for r in simhash.links(fps).collect()}
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert pairs == want
    root = linked(values)
    by_root = {}
    for i, v in zip(ids, values):
        by_root.setdefault(root[v], []).append(i)
    got = {r.doc_id: r.component_id for r in simhash.groups(fps).where("doc_id is not null").collect()}
    assert got == {i: min(by_root[root[v]]) for i, v in zip(ids, values)}
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.near_duplicates(frame(spark, messy(texts()))).count() == len(messy(texts()))
