"""Word-wise encoding: other tokenizers, special tokens, long texts, pieces of batches."""

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from flowbeam.llm import orc_tokens
from flowbeam.llm.queries import TOKENIZER


def direct(tokenizer, texts):
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def encoded(encoder, texts):
    ids, counts = encoder.encode_column(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_tokenizer_that_keeps_case_is_not_lower_cased(tmp_path):
    """A cased tokenizer's words are not the ids of lower-cased words."""
    import json

    spec = json.loads(Tokenizer.from_file(TOKENIZER).to_str())
    spec["normalizer"] = None
    path = str(tmp_path / "cased.json")
    with open(path, "w") as f:
        json.dump(spec, f)
    encoder, tokenizer = orc_tokens.TextEncoder(path), Tokenizer.from_file(path)
    assert not encoder.by_word
    texts = ["Hello World", "hello world", "", None]
    assert encoded(encoder, texts) == direct(tokenizer, texts)
    assert encoded(encoder, texts)[0] != encoded(encoder, texts)[1]


def test_blanks_specials_and_slices():
    tokenizer, encoder = Tokenizer.from_file(TOKENIZER), orc_tokens.TextEncoder(TOKENIZER)
    special = encoder.special[0]
    texts = ["", None, "  ", " a\tb \n", f"x {special} y", "one two", f"{special.upper()}", "\x0b\x0c\r", "two, one."]
    assert encoded(encoder, texts) == direct(tokenizer, texts)
    column = pa.array(["zzz"] + texts, pa.string()).slice(1)
    ids, counts = encoder.encode_column(column)
    assert ids.tolist() == [i for x in direct(tokenizer, texts) for i in x] and len(counts) == len(texts)
    assert encoder.encode([]) == []


def test_long_text_and_pieces():
    tokenizer, encoder = Tokenizer.from_file(TOKENIZER), orc_tokens.TextEncoder(TOKENIZER, 5_000)
    long = " ".join(f"word{k % 7919} again," for k in range(60_000))
    assert encoded(encoder, [long, "x", long]) == direct(tokenizer, [long, "x", long])
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a" * 10, None, "b" * 100, "c", "d" * 5, ""])})
    assert [p.num_rows for p in orc_tokens._pieces(batch, 12)] == [2, 1, 3]
