"""Ids of packed texts against an untouched tokenizer, texts with added tokens included."""

import zlib

import numpy as np

from peakloom.llm import packing


def test_added_tokens(spark):
    from tokenizers import Tokenizer

    paths = packing.public_bpe()
    library, encoder = Tokenizer.from_file(paths["path"]), packing.Encoder(**paths)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n", "<|endoftext |>", "plain é🎉 text  "]
    ids = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids[0] == [64, 220, 50256, 275]
    for t, own in zip(texts, ids):
        assert np.frombuffer(encoder(t), "<u4").tolist() == own
        assert np.frombuffer(packing.Encoder(paths["path"])(t), "<u4").tolist() == own
    rows = packing.tokenized(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), paths).collect()
    assert {r["doc_id"]: (r["doc_tokens"], r["crcs"]) for r in rows} == {
        i: (len(own) + 1, [zlib.crc32(np.array([*own, packing.END], "<u4").tobytes())]) for i, own in enumerate(ids)}
