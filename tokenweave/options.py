"""Options of building and searching an index, with their rules."""

from __future__ import annotations

from dataclasses import dataclass

SEED = 42
PADDED_DIM = 128
QUERY_TOKENS = 32


@dataclass(frozen=True)
class SearchOptions:
    """``cagra_itopk_size`` is validated for compatibility; probing is exact."""

    nprobe: int = 128
    k_refine: int = 3000
    k_full_bit: int = 300
    cagra_itopk_size: int = 150
    num_chunks: int = 5

    def __post_init__(self):
        for name in ("nprobe", "k_refine", "k_full_bit", "cagra_itopk_size", "num_chunks"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.k_full_bit > self.k_refine:
            raise ValueError("k_full_bit must not exceed k_refine")

    def check_clusters(self, n_clusters: int) -> None:
        if self.nprobe > n_clusters:
            raise ValueError("nprobe must not exceed n_clusters")


def clusters_for(n_tokens: int) -> int:
    """One cluster for 100 tokens, 64 at least."""
    return min(n_tokens, max(64, -(-n_tokens // 100)))


def options_for(n_clusters: int, n_docs: int) -> SearchOptions:
    """The defaults, or shares where these are more: half of the clusters, a quarter
    of the documents and a twentieth of them for full-bit scores.  Fixed numbers
    would lose ever more neighbours as a table grows."""
    plain = SearchOptions()
    nprobe = min(n_clusters, max(plain.nprobe, -(-n_clusters // 2)))
    return SearchOptions(nprobe, max(plain.k_refine, -(-n_docs // 4)), max(plain.k_full_bit, -(-n_docs // 20)), max(plain.cagra_itopk_size, nprobe), plain.num_chunks)


@dataclass(frozen=True)
class BuildOptions:
    n_clusters: int
    ex_bits: int
    padded_dim: int = PADDED_DIM
    seed: int = SEED
    least_dim: int = 64

    def __post_init__(self):
        if self.n_clusters < 1:
            raise ValueError("n_clusters must be at least 1")
        if not 1 <= self.ex_bits <= 7:
            raise ValueError("ex_bits must be between 1 and 7")
        if self.padded_dim <= 0 or self.padded_dim & (self.padded_dim - 1) or self.padded_dim % 64:
            raise ValueError("padded_dim must be a power of two and a multiple of 64")

    def check(self, n_tokens: int, dim_least: int, dim_most: int) -> None:
        if not n_tokens:
            raise ValueError("there are no embeddings")
        if dim_least != dim_most:
            raise ValueError("embeddings differ in dimension")
        if not self.least_dim <= dim_least <= self.padded_dim:
            raise ValueError(f"dimension must be between {self.least_dim} and {self.padded_dim}")
        if self.n_clusters > n_tokens:
            raise ValueError("n_clusters must not exceed the number of embeddings")
