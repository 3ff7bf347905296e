"""Public tokenizers, read from the path that the caller gives; every worker reads the file once."""

from __future__ import annotations

import base64
import functools

#: Where the vocabulary lies on every machine of the cluster; a parameter of all that uses it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@functools.cache
def encoding(path: str = VOCABULARY):
    """The byte-level BPE of a rank file; it has no special tokens, so that all text is ordinary."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
