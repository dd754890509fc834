"""Parameters shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Settings:
    """Default parameters; pass a changed copy (`with_`) to override."""

    # tokens
    min_word_length: int = 3
    max_word_length: int = 50
    min_doc_length: int = 30
    use_stemming: bool = False
    use_bigrams: bool = True
    use_trigrams: bool = False
    bigram_min_count: int = 20
    trigram_min_count: int = 10
    phrase_threshold: float = 10.0
    # dictionary
    no_below: int = 20
    no_above: float = 0.5
    keep_n: int = 100_000
    # topic model
    passes: int = 20
    chunk_size: int = 3000
    seed: int = 42
    # cleaning
    min_abstract_words: int = 20
    missing_label: str = "Tidak Diketahui"

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)
