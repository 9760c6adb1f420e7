import base64
import gzip
import hashlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F
from riskframe.llm import chat_format as chat
from riskframe.llm import queries, warc

SMOKE = "/root/testdata/sf0.001"
b32 = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_records_come_back_and_are_gzip_members():
    payloads = [b"", b"x", "é\r\n\r\nWARC/1.1\r\n".encode(), bytes(range(256)) * 4000]
    data = b"".join(warc.record_bytes(n, f"http://h/{n}\r\nX: y é", p, None, "2026-01-01T00:00:00Z") for n, p in enumerate(payloads))
    got = list(warc.read_records(io.BytesIO(data), with_payload=True))
    assert [r.payload for r in got] == payloads
    assert [r.payload_digest for r in got] == [b32(p) for p in payloads]
    assert gzip.decompress(data).count(b"WARC-Type: response") == len(payloads)


@pytest.mark.parametrize("harm", ["cut", "digest", "length", "junk"])
def test_bad_archives_are_refused(harm):
    data = warc.record_bytes(1, None, b"payload " * 50, None, "2026-01-01T00:00:00Z")
    plain = gzip.decompress(data)
    bad = {"cut": data[:-20], "digest": gzip.compress(plain.replace(b"payload payload", b"payload Payload")),
           "length": gzip.compress(plain.replace(b"Content-Length: 4", b"Content-Length: 9")), "junk": b"not gzip at all"}[harm]
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(bad)))


def test_pages_with_copies_nulls_and_ties(spark):
    rows = [(1, "u", "same"), (2, None, "same"), (3, "u", "same"), (3, "u", "same"), (4, "u", None), (5, "u", ""),
            (None, "u", "alone"), (6, "é\nx", "long " * 300_000), (None, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("x"))
    got = warc.archive_round_trip(pages, spark).collect()
    assert len(got) == len(rows)
    html = {}
    for p, u, h in rows:
        html.setdefault(p, []).append(h or "")
    for r in got:
        assert any((len(h.encode()), b32(h.encode())) == (r["payload_bytes"], r["payload_digest"]) for h in html[r["page_id"]])
    kind = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"] == 4)
    assert kind == [(0, "revisit", 3), (1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (3, "response", None)]
    assert {r["page_id"]: r["refers_to"] for r in got if r["payload_bytes"] == 0} == {4: 5, 5: None}
    assert {r["url"] for r in got if r["page_id"] == 6} == {"é\nx"}
    assert warc.archive_round_trip(pages.limit(0), spark).count() == 0


def test_every_page(spark):
    pages = spark.read.parquet(f"{SMOKE}/pages.parquet").collect()
    got = {r["page_id"]: r for r in queries.QUERIES["op8_warc"](spark, SMOKE).collect()}
    last = {}
    for p in pages:
        last[p["html"] or ""] = max(last.get(p["html"] or "", -1), p["page_id"])
    assert len(got) == len(pages)
    for p in pages:
        h = p["html"] or ""
        r = got[p["page_id"]]
        revisit = last[h] != p["page_id"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(h.encode()), b32(h.encode()))
        assert (r["record_type"], r["refers_to"]) == (("revisit", last[h]) if revisit else ("response", None))


def test_escaping_is_reversible():
    for s in ["", "<s>", "<\\s>", "<\\\\s>", "[INST] [/INST] </s>", "<|im_end|>\n<|im_start|>user\n", "<<SYS>><</SYS>>", "\\", "<<s>>", "[\\INST]"]:
        e = chat.escape(s)
        assert chat.unescape(e) == s
        assert not any(c in e for c in chat.CONTROL)


@pytest.fixture(scope="module")
def tokenizer():
    with open(queries.CHAT_TOKENIZER, "rb") as f:
        return chat.MarkedTokenizer(f.read())


TURNS = [("user", "q"), ("assistant", ""), ("assistant", "\n\n🦙é a<"), ("system\n", "x"), ("assistant", "</s>tail\n"),
         ("assistant", "<"), ("user", "\n"), ("assistant", " ok."), ("", "<|im_sep|>"), ("assistant", "<|im_end|>\n日本")]


def masked(tokenizer, turns):
    r = chat.render(turns)
    ids, first, end = tokenizer.encode(r.text)
    return r, ids, first, end, chat.token_mask(first, end, r.starts, r.ends)


def test_mask_covers_exactly_the_trained_text(tokenizer):
    r, ids, first, end, mask = masked(tokenizer, TURNS)
    data = r.text.encode()
    assert tokenizer.encoding.decode_bytes(ids.tolist()) == data and end[-1] == len(data)
    under = {i for a, b in zip(first[mask].tolist(), end[mask].tolist(), strict=True) for i in range(a, b)}
    assert under == {i for a, b in zip(r.starts, r.ends, strict=True) for i in range(a, b)}
    assert tokenizer.masked_texts(ids, mask) == [x for role, x in TURNS if role == "assistant" and x]
    assert chat.parse(r.text) == TURNS


def test_any_changed_mask_bit_changes_the_trained_text(tokenizer):
    _, ids, _, _, mask = masked(tokenizer, TURNS)
    right = "".join(tokenizer.masked_texts(ids, mask))
    for n in range(len(mask)):
        wrong = mask.copy()
        wrong[n] = not wrong[n]
        assert "".join(tokenizer.masked_texts(ids, wrong)) != right, n


def test_long_white_space_is_cut_as_the_pattern_would(tokenizer):
    for text in ["a" + " " * 20_000 + "b", "\n" * 12_000, " " * 30_000 + "<|im_end|>" + " " * 11_000, "x\u3000" * 3 + "\t" * 10_000 + " y"]:
        ids, first, end = tokenizer.encode(text)
        assert ids.tolist() == tokenizer.encoding.encode(text, allowed_special="all")
        assert end.tolist() == np.cumsum([len(tokenizer.encoding.decode_single_token_bytes(i)) for i in ids.tolist()]).tolist()
    ids, _, end = tokenizer.encode(" " * 3_000_000 + "x")
    assert end[-1] == 3_000_001


def expected(rows):
    convs = {}
    for c, t, role, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for c, turns in convs.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss))
    return out


def test_every_conversation(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMOKE}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
           for r in queries.QUERIES["op2_chat_format"](spark, SMOKE).collect()}
    assert got == expected(rows)


def test_odd_conversations(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, None, "assistant", "x"), (None, 2, "assistant", "a\n<|im_end|>\n"),
            (None, 1, "a\nb", "<|im_start|>"), (2, 5, "assistant", "long " * 50_000), (3, 0, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
           for r in chat.format_conversations(turns, queries.CHAT_TOKENIZER).collect()}
    assert got == expected(rows)
    assert chat.format_conversations(turns.limit(0), queries.CHAT_TOKENIZER).count() == 0
