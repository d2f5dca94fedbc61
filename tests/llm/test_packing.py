import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm_cases import edge_docs, edge_rows, no_docs  # noqa: F401
from lastmile.llm import packing
from lastmile.llm.tokenizing import Encoder, default_paths

FULL = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENCODER = Encoder(*default_paths())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from(" \n\t'’漢 \x1c"))))
def test_ids_are_those_of_the_tokenizers_file(text):
    assert ENCODER.ids(text).tolist() == FULL.encode(text, add_special_tokens=False).ids


def test_special_strings_follow_the_file():
    text = "a <|endoftext|> b"
    assert ENCODER.ids(text).tolist() == FULL.encode(text, add_special_tokens=False).ids


def test_pieces_and_sequences(edge_docs, edge_rows, no_docs):
    rows = packing.pack_documents(edge_docs, length=64).collect()
    want = defaultdict(int)
    for r in edge_rows:
        ids = np.array([*FULL.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 64 or 64
        for k, a in enumerate([0, *range(first, len(ids), 64)]):
            part = ids[a : first if k == 0 else a + 64]
            want[r[0], k, a, len(part), zlib.crc32(part.tobytes())] += 1
    got = defaultdict(int)
    held = defaultdict(list)
    for r in rows:
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(no_docs).count() == 0


def test_rounds_join_what_groups_leave(spark):
    rnd = random.Random(4)
    sizes = [rnd.randrange(1, 100) for _ in range(4000)]
    sized = spark.createDataFrame(list(enumerate(sizes)), "item long, length long")
    rows = packing.pack(sized, length=100, group=1000, room=0).collect()
    assert sorted(r["item"] for r in rows) == list(range(4000))
    assert len({r["sequence_id"] for r in rows}) <= 1.03 * sum(sizes) / 100
