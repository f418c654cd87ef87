"""Very long texts and very long words go through every operator whole."""

import random

import pytest
import sentencepiece
from test_repeats import B, W, bytes_by_hand, tuples, words_by_hand
from test_rowwise import MODEL, as_tuples, chats_by_hand, said, spans_by_hand
from test_similar import found_rows, got_rows, leaks_by_hand, want_rows

from framewright.llm import chat_format, decontaminate, language_id, mixing, ngram_join, secret_scan, substring_dedup, suffix_dedup, token_counts


@pytest.fixture(scope="module")
def long_rows():
    rng = random.Random(20)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    text = [word() for _ in range(30_000)]
    text[9000] = "".join(rng.choice("abc") for _ in range(90_000))
    text[20_000] = "password=" + "x1" * 20_000
    near = list(text)
    near[100] = "changed"
    return [(1, " ".join(text)), (2, " ".join(near)), (3, " ".join(text[8990:9010])), (4, "z" * 120_000), (5, "short text"), (None, " ".join(text[:300]))]


def test_long_texts(spark, docs_of, long_rows):
    docs = docs_of(long_rows)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, MODEL).collect()} == {d: len(sp.encode(t)) for d, t in long_rows}
    for r in secret_scan.secret_scan(docs).collect():
        base = [s for s in r["spans"] if s["kind"] != "opaque"]
        assert ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in base) == said(spans_by_hand(dict(long_rows)[r["doc_id"]]))
    assert tuples(substring_dedup.substring_dedup(docs), W) == words_by_hand(long_rows, 13)
    assert tuples(suffix_dedup.suffix_dedup(docs), B) == bytes_by_hand(long_rows, 400)
    assert got_rows(ngram_join.ngram_join(docs)) == want_rows(long_rows)
    assert {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()} == {d: len(t.split()) for d, t in long_rows}
    items = [(1, long_rows[2][1]), (2, " ".join(long_rows[0][1].split()[500:3000])), (3, long_rows[0][1].split()[9000])]
    assert found_rows(decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string"))) == leaks_by_hand(long_rows, items)
    told = {r["doc_id"]: r["lang_pred"] for r in language_id.language_id(docs).collect()}
    assert len(told) == 6 and set(told.values()) == {"en"}
    chats = [(7, i, "assistant" if i % 2 else "user", t) for i, (_, t) in enumerate(long_rows)]
    assert as_tuples(chat_format.digests(chat_format.chat_format(spark.createDataFrame(chats, "conv_id long, turn long, role string, text string")))) == chats_by_hand(chats)
