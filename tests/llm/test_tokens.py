import numpy as np
import pytest
import sentencepiece
from riskframe.llm import sentencepiece_codec as codec
from riskframe.llm import token_counts
from riskframe.llm.unigram_vocab import load_vocab
from sentencepiece import sentencepiece_model_pb2 as pb

PATH = "/opt/tokenizers/piece_bpe_32k.model"
TEXTS = ["", "a", " ", "  a  b ", "the the  other\tone", "x\n\n🦙 y z", "é ü 日本語のテキスト", "⁇ \x00\x7f", "a" * 3000,
         "word " * 2000, "ß" * 50 + " " * 50 + "end"]


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The pieces read as a unigram model by the public library, with scores whose sums are exact in its float32."""
    model = pb.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        p.score = max(p.score, -40000.0)
    path = tmp_path_factory.mktemp("model") / "uni.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


def encode(path, texts):
    vocab = load_vocab(path)
    got = codec.CachedEncoder(vocab, codec.DoubleArrayTrie(vocab.pieces)).encode([t.encode() for t in texts])
    return [np.frombuffer(g, "<i4").tolist() for g in got]


def test_trie_holds_every_piece():
    vocab = load_vocab(PATH)
    trie = codec.DoubleArrayTrie(vocab.pieces)
    for raw, (piece_id, _) in list(vocab.pieces.items())[::37]:
        s = 0
        for c in raw:
            t = int(trie.base[s]) + c
            assert trie.check[t] == s
            s = t
        assert trie.piece[s] == piece_id


def test_same_ids_as_the_library(spark, unigram):
    lib = sentencepiece.SentencePieceProcessor(model_file=unigram)
    rows = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    pieces = [t for r in rows if r for t in r.split("\n")[:6]]
    for texts in (pieces, [t for t in TEXTS if len(t) < 200]):
        assert encode(unigram, texts) == lib.encode(texts)


def test_round_trip_and_count_of_odd_texts():
    vocab = load_vocab(PATH)
    ids = encode(PATH, TEXTS)
    counts = token_counts.TokenCounter(vocab).count([t.encode() for t in TEXTS])
    assert counts == [len(i) for i in ids]
    for t, i in zip(TEXTS, ids, strict=True):
        assert codec.decode_ids(np.array(i, np.int64), vocab.texts, vocab.dummy_prefix).decode() == t


def test_bytes_that_are_not_text():
    vocab = load_vocab(PATH)
    assert codec.decode_ids(np.array([vocab.byte_ids[0xFF]]), vocab.texts, True).decode() == "�"
    with pytest.raises(IndexError):
        codec.decode_ids(np.array([10**6]), vocab.texts, True)


def test_queries_on_odd_rows(spark):
    rows = [(n, t, "x") for n, t in enumerate(TEXTS)] + [(None, "a b", None), (3, None, "x"), (3, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _pieces string")
    got = codec.encoded_documents(docs, PATH).collect()
    counts = token_counts.document_token_counts(docs, PATH).collect()
    assert len(got) == len(counts) == len(rows)
    key = lambda r: (r["doc_id"] is None, r["doc_id"], -1 if r["n_tokens"] is None else r["n_tokens"])
    assert sorted(map(key, got), key=str) == sorted(map(key, counts), key=str)
    assert all(r["round_trip"] for r in got if r["ids"] is not None)
    assert sum(r["ids"] is None for r in got) == 2
    back = codec.decode(codec.encode(docs, PATH, out_col="p").select("text", "p.ids"), PATH, out_col="again")
    assert all(r["text"] == r["again"] for r in back.collect())
    empty = docs.limit(0)
    assert codec.encoded_documents(empty, PATH).count() == token_counts.document_token_counts(empty, PATH).count() == 0


def plain_viterbi(text, vocab, longest):
    """The best path over the whole text at once: of equal scores the one whose last piece starts first."""
    s = ("▁" if vocab.dummy_prefix and text else "") + text.replace(" ", "▁")
    best, back = [0.0] + [-float("inf")] * len(s), [None] * (len(s) + 1)
    for start in range(len(s)):
        single = False
        for end in range(start + 1, min(len(s), start + longest) + 1):
            piece = vocab.pieces.get(s[start:end].encode())
            if piece is not None:
                single |= end == start + 1
                if best[start] + piece[1] > best[end]:
                    best[end], back[end] = best[start] + piece[1], (start, [piece[0]])
        if not single and best[start] + vocab.unknown_score > best[start + 1]:
            ids = [vocab.byte_ids[b] for b in s[start].encode()]
            best[start + 1], back[start + 1] = best[start] + vocab.unknown_score, (start, ids)
    out, at = [], len(s)
    while at:
        at, ids = back[at]
        out[:0] = ids
    return out


def test_whole_documents_against_one_plain_path(spark):
    vocab = load_vocab(PATH)
    longest = max(len(p.decode()) for p in vocab.pieces)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if len(r["text"] or "") < 20_000}
    ids = {r["doc_id"]: list(r["ids"]) for r in codec.encoded_documents(docs, PATH).collect() if r["ids"] is not None}
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.document_token_counts(docs, PATH).collect()}
    for d, text in texts.items():
        if text is not None:
            want = plain_viterbi(text, vocab, longest)
            assert ids[d] == want and counts[d] == len(want)
