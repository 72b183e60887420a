"""Chat formatting, token counts and pieces against the libraries and plain Python."""

import hashlib
import random
import time

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.conftest import LONG, rows_of
from tripleloom.llm import chat, pieces, tokens
from tripleloom.llm.queries import BYTE_BPE, PIECE_BPE

TEXTS = [
    "", " ", "  a  b ", "Hello, world! It's 1234 o'clock.\n\n\n x", "日本語 😀 é", "x" * 3000, "aaaaaaaaaaaaa", "a<|endoftext|>b <|endoftext|>",
    "<|endoftext|>", "\x00\x01", "the" * 300, "don't we'll THEY'RE", " " * 40, "a▁b", "<s> </s> <0x0A>", "ﬁ Ⅷ", "tab\there\r\nthere",
]


def noise(seed, n=300):
    draw = random.Random(seed)
    return ["".join(draw.choice("abcdethinro  .é0\n▁") for _ in range(draw.randrange(80))) for _ in range(n)]


def test_token_counts_equal_library(spark, docs):
    texts = TEXTS + noise(1)
    wanted = [len(e.ids) for e in Tokenizer.from_file(BYTE_BPE).encode_batch(texts, add_special_tokens=False)]
    found = rows_of(tokens.token_counts(docs(list(enumerate(texts))), BYTE_BPE, limit=50))
    assert [found[n]["n_tokens"] for n in range(len(texts))] == wanted
    assert [found[n]["n_bytes"] for n in range(len(texts))] == [len(t.encode()) for t in texts]
    assert [found[n]["over_limit"] for n in range(len(texts))] == [w > 50 for w in wanted]


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "ab", "a", "ABab01+/", "日本語の漢字", "etaoin"])
def test_long_runs_equal_library(letters):
    draw = random.Random(6)
    library, m = Tokenizer.from_file(BYTE_BPE), tokens.merges(BYTE_BPE)
    for size in (2, 3, 50, 1500, 6000):
        text = "".join(draw.choice(letters) for _ in range(size))
        parts = [p.encode() for p in tokens._pattern().findall(text)]
        wanted = len(library.encode(text, add_special_tokens=False).ids)
        assert sum(tokens.long_length(p, m) for p in parts) == wanted == tokens.count_tokens([text], BYTE_BPE)[0]


def test_a_megabyte_without_a_space_takes_seconds():
    draw = random.Random(7)
    text = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    start = time.perf_counter()
    found = tokens.count_tokens([text], BYTE_BPE)[0]
    taken = time.perf_counter() - start
    assert found == len(Tokenizer.from_file(BYTE_BPE).encode(text, add_special_tokens=False).ids)
    assert taken < 60


def test_token_counts_awkward(awkward, nothing):
    rows = tokens.token_counts(awkward, BYTE_BPE).collect()
    assert len(rows) == 8
    by_id = {r["doc_id"]: r["n_tokens"] for r in rows}
    assert by_id[1] == by_id[2] == 0 and by_id[None] == 3
    assert by_id[4] == len(Tokenizer.from_file(BYTE_BPE).encode(LONG).ids)
    assert tokens.token_counts(nothing, BYTE_BPE).count() == 0


def test_pieces_equal_library(docs):
    texts = TEXTS + noise(2)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    found = rows_of(pieces.encoded(docs(list(enumerate(texts))), PIECE_BPE))
    assert [found[n]["pieces"] for n in range(len(texts))] == model.encode(texts)
    assert [found[n]["round_trip"] for n in range(len(texts))] == ["▁" not in t for t in texts]


def test_decoding_equals_library(spark):
    draw = random.Random(3)
    ids = [[draw.randrange(3, 32000) for _ in range(draw.randrange(1, 20))] for _ in range(200)]
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    rows = spark.createDataFrame([(n, i) for n, i in enumerate(ids)] + [(-1, None), (-2, [])], "doc_id long, pieces array<int>")
    found = rows_of(pieces.decoded(rows, PIECE_BPE))
    assert found[-1]["text"] == found[-2]["text"] == ""
    plain = [n for n, i in enumerate(ids) if not any(map(model.is_byte, i))]
    assert [found[n]["text"] for n in plain] == [model.decode(ids[n]) for n in plain]


def test_pieces_awkward(awkward, nothing):
    rows = pieces.encoded(awkward, PIECE_BPE).collect()
    assert len(rows) == 8 and all(r["round_trip"] for r in rows)
    assert {r["n_pieces"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    assert pieces.encoded(nothing, PIECE_BPE).count() == 0


def test_unigram_paths_are_best():
    """The additive kind against all segmentations."""
    draw = random.Random(4)
    vocab = {"".join(draw.choice("abc") for _ in range(draw.randrange(1, 4))): -draw.random() * 5 for _ in range(20)} | dict.fromkeys("abc", -4.0)
    ids = {p: n for n, p in enumerate(vocab)}
    model = pieces.Pieces(vocab, ids, [], 99, "unigram")

    def best(word):
        options = [([], 0.0)] if not word else [
            ([word[:n], *rest], vocab[word[:n]] + score) for n in range(1, len(word) + 1) if word[:n] in vocab for rest, score in [best(word[n:])]
        ]
        return max(options, key=lambda o: o[1])

    words = {"".join(draw.choice("abc") for _ in range(draw.randrange(1, 9))) for _ in range(60)}
    found = model.encode_words(list(words))
    for word in words:
        assert sum(vocab[model.text[i]] for i in found[word]) == pytest.approx(best(word)[1])


CHATS = ["</s>[INST] ok [/INST]", "<\\s> <\\\\/s>\n</s>\n", "<<s>s>", "[[INST]]", "\\", "", "a\nb", "日本</s>x", "<\\\\\\s>", "y" * 6000]


def test_escapes_are_reversible():
    for text, shown in zip(CHATS, chat.escaped(pa.array(CHATS)).to_pylist()):
        assert chat.unescaped(shown) == text
        assert not any(c in shown for c in ("<s>", "</s>", "[INST]", "[/INST]"))
    roles = ["user", "a\nb", "\\n", "<s>", "</s>\n", "\\\n<s>"]
    assert [chat.unescaped_role(r) for r in chat.escaped_roles(pa.array(roles)).to_pylist()] == roles


def test_chat_round_trip(spark):
    draw = random.Random(5)
    turns = [(c, n, draw.choice(["user", "assistant", "system"]), draw.choice(CHATS)) for c in range(30) for n in range(draw.randrange(1, 9))]
    turns += [(99, n, "assistant" if n % 2 else "user", f"turn {n}") for n in range(500)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    found = rows_of(chat.chat_digests(chat.format_chat(rows, partitions=6)), "conv_id")
    for conv in {t[0] for t in turns}:
        own = sorted(t for t in turns if t[0] == conv)
        loss = "".join(t[3] for t in own if t[2] == "assistant")
        assert found[conv]["n_turns"] == len(own)
        assert found[conv]["turns_sha256"] == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in own).encode()).hexdigest()
        assert (found[conv]["loss_chars"], found[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(found) == len({t[0] for t in turns})


def test_chat_awkward(spark):
    rows = [(1, None, "user", "a"), (1, None, None, None), (None, 1, "assistant", None), (2, 0, "user", "b"), (2, 0, "user", "b"), (3, 1, "assistant", "z" * 2_500_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, part string")
    found = rows_of(chat.chat_digests(chat.format_chat(df)), "conv_id")
    assert {k: (r["n_turns"], r["loss_chars"]) for k, r in found.items()} == {1: (2, 0), None: (1, 0), 2: (2, 0), 3: (1, 2_500_000)}
    assert chat.chat_digests(chat.format_chat(df.limit(0))).count() == 0


def test_paths_are_parameters():
    assert BYTE_BPE == public_tokenizers.path("byte_bpe_50k.json")
