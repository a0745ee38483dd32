from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken

from framewitness.llm import byte_bpe, exact_dedup, sharding
from tests.llm.edge import frame, got, rows


def _hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def plain_exact(data):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(data):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, k))
    out = []
    for norm, members in groups.items():
        members.sort()
        for m in members:
            keep = data[members[0][3]][0]
            out.append((data[m[3]][0], keep, len(members), m is members[0], _hash(norm.encode())))
    return sorted(out, key=repr)


NAMES = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_exact_dedup(spark, limit):
    data = rows() + [(100 + i, "hot copy" + " " * (i % 3)) for i in range(40)]
    docs = frame(spark, data)
    found = exact_dedup.exact_dedup(docs, slice_rows=limit)
    found = found.selectExpr("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got(found, *NAMES) == plain_exact(data)


def test_exact_dedup_stage_and_empty(spark):
    data = rows()
    docs = frame(spark, data)
    kept = exact_dedup.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert Counter(r.text for r in kept.collect()).most_common(1)[0][1] == 1
    assert kept.count() == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in data})
    assert exact_dedup.decisions(frame(spark, [])).count() == 0


def test_sharding(spark):
    data = rows() + [(1000 + i, f"text {i}") for i in range(3_000)]
    found = sharding.shards(frame(spark, data)).collect()
    assert len(found) == len(data)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(16))
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in data), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in found), key=repr) == want
    for r in found[:200]:
        key = "null" if r.doc_id is None else str(r.doc_id)
        best = max(range(16), key=lambda s: (int(hashlib.md5(f"{key}/{s}".encode()).hexdigest()[:13], 16), -s))
        assert r.shard == best
    assert sharding.shards(frame(spark, [])).count() == 0


def test_sharding_weights(spark, tmp_path):
    docs = frame(spark, [(i, f"t{i}") for i in range(8_000)], extra=False)
    count = Counter(r.shard for r in sharding.shards(docs, [1.0, 3.0]).collect())
    assert 0.22 < count[0] / 8_000 < 0.28
    sharding.write_shards(docs, str(tmp_path / "out"), [1.0, 1.0], files=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8_000
    with pytest.raises(ValueError):
        sharding.shards(docs, [1.0, 0.0])


def test_byte_bpe(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(byte_bpe.RANKS), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in rows():
        ids = plain.encode_ordinary(t or "")
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        want.append((i, len(ids), _hash(packed), _hash((t or "").encode())))
    found = byte_bpe.digests(frame(spark, rows()))
    assert got(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert byte_bpe.digests(frame(spark, [])).count() == 0


def test_byte_bpe_offsets(spark):
    docs = frame(spark, [(1, "héé 😀x it's"), (2, None)], extra=False)
    one, two = sorted(byte_bpe.tokens(docs, offsets=True).collect(), key=lambda r: r.doc_id)
    assert len(one.ids) == len(one.starts) and one.ends[-1] == len("héé 😀x it's") and two.ids == []
    assert all(b >= a for a, b in zip(one.starts, one.starts[1:]))
    # ids that split a character decode together
    cut = one.ids[:4], one.ids[4:]
    assert b"".join(byte_bpe.decode(c) for c in cut).decode() == "héé 😀x it's"
