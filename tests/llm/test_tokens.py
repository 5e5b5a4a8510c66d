import base64

import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexwarden.llm import bpe, token_count
from lexwarden.llm.queries import TOKENIZERS

SMALL = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
MULTI = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
ODD = ["", " ", "\n\n  a", "a" * 5000, "ab" * 999, "が" * 3000, "é" * 700, "<|endoftext|>x", "it's I'LL", "\t　​ x", "👍🏽🙂", "123456789" * 50, "\x00\x01"]


def reference(path):
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(sf_dir, name, column):
    return pq.read_table(f"{sf_dir}/{name}.parquet", columns=[column]).column(0).to_pylist()


def ids_of(encoder, batch):
    flat, offsets = encoder.encode_batch(batch)
    return [flat[a:b] for a, b in zip(offsets, offsets[1:])]


def test_rank_queue_order():
    queue = bpe.RankQueue(50_000)
    for rank in (49_999, 3, 70, 3, 4_097, 0):
        queue.add(rank, rank)
    got = []
    while (item := queue.pop()) is not None:
        got.append((item[0], len(item[1])))
    assert got == [(0, 1), (3, 2), (70, 1), (4_097, 1), (49_999, 1)]
    queue.add(5, 1)
    assert queue.pop() == (5, [1]) and queue.pop() is None


def test_ids_against_the_libraries(sf_dir):
    batch = [*texts(sf_dir, "documents", "text"), *ODD]
    got = ids_of(bpe.load_encoder(SMALL), batch)
    other = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    assert got == [e.ids for e in other.encode_batch([t or "" for t in batch], add_special_tokens=False)]
    assert got == [reference(SMALL).encode_ordinary(t or "") for t in batch]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_ids_of_any_text(batch):
    assert ids_of(bpe.load_encoder(MULTI), batch) == [reference(MULTI).encode_ordinary(t) for t in batch] if batch else True


def test_small_cache(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_SIZE", 3)
    encoder = bpe.Encoder(bpe.load_encoder(SMALL).ranks)
    assert ids_of(encoder, ["one two three four five", "six one"]) == ids_of(bpe.load_encoder(SMALL), ["one two three four five", "six one"])


def greedy(vocabulary, word):
    out, at = [], 0
    while at < len(word):
        size = max(n for n in range(1, len(word) - at + 1) if word[at : at + n] in vocabulary)
        out.append(vocabulary[word[at : at + size]])
        at += size
    return out


@settings(max_examples=200, deadline=None)
@given(st.sets(st.binary(min_size=2, max_size=6).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=12), st.lists(st.integers(0, 2), max_size=30))
def test_trie_is_longest_match(words, picks):
    vocabulary = {w: i for i, w in enumerate([b"a", b"b", b"c", *sorted(words)])}
    word = bytes(97 + p for p in picks)
    assert token_count.MatchTrie(vocabulary).tokens(word) == greedy(vocabulary, word)


def test_counts_are_exact_and_estimates_close(sf_dir):
    batch = [*texts(sf_dir, "canonical_examples", "text"), *texts(sf_dir, "documents", "text"), *ODD]
    want = [len(reference(MULTI).encode_ordinary(t or "")) for t in batch]
    assert token_count.load_counter(MULTI, True).count_batch(batch) == want
    estimate = token_count.load_counter(MULTI, False).count_batch(batch)
    assert abs(sum(estimate) / sum(want) - 1) < 0.02


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_counts_of_any_text(text):
    assert token_count.load_counter(MULTI, True).count_batch([text]) == [len(reference(MULTI).encode_ordinary(text))]


def test_operators(spark):
    df = spark.createDataFrame([(1, "a b", "en"), (2, None, None), (3, "", "en"), (1, "a b", "en")], "ids0 long, text string, n_texts string")
    got = sorted((r.ids0, r.ids) for r in bpe.encode_corpus(df, "ids0", "text", SMALL).collect())
    assert got == [(1, [64, 275]), (1, [64, 275]), (2, []), (3, [])]
    counted = token_count.token_counts(df, "text", SMALL, ["ids0", "n_texts"])
    assert sorted(r.n_tokens for r in counted.collect()) == [0, 0, 2, 2]
    budget = {r.lang: (r.n_texts, r.n_tokens) for r in token_count.token_budget(counted.withColumnRenamed("n_texts", "lang"), ["lang"]).collect()}
    assert budget == {"en": (3, 4), None: (1, 0)}
    assert bpe.encode_corpus(df.limit(0), "ids0", "text", SMALL).count() == 0


def test_missing_vocabulary():
    with pytest.raises(FileNotFoundError):
        bpe.load_encoder("/nowhere.tiktoken")
