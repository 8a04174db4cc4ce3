"""Where vocabulary files come from, and tokenizers that are loaded once in each worker."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

#: Names of files in the tokenizer folder.
BYTE_BPE, BYTE_BPE_RANKS, PIECES = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """A vocabulary file: in ``folder`` if given, else where the installed package has it."""
    if folder is not None:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def fast_tokenizer(path: str, added: tuple[str, ...] = ()):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(path)
    if added:
        t.add_special_tokens([AddedToken(a, special=True, normalized=False) for a in added])
    return t


@lru_cache(maxsize=4)
def rank_encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
