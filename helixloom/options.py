"""Settings of an assembly run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """Every setting that changes a result; defaults are those of an unconfigured run.

    strand: "unstranded", "first" or "second". output_mode: "assembly" or "full".
    frag_mean and frag_sd override the estimate and go together. library_size 0 means
    that expression is relative to the unique pairs that are left after deduplication.
    inclusion_prior: (a, b) of a Beta prior of the share of candidates that are expressed, instead
    of the share of the greedy cover. start: "multinomial" or "cover", where a chain begins.
    fixed_support: expression is sampled again with the most frequent set of expressed candidates.
    """

    strand: str = "unstranded"
    confidence_threshold: float = 0.5
    count_threshold: float = 12.0
    pre_mrna: bool = True
    seed: int = 1
    output_mode: str = "assembly"
    library_size: int = 0
    max_candidates: int = 100
    gamma: float = 1.0
    frag_mean: float | None = None
    frag_sd: float | None = None
    base_iterations: int = 1000
    iterations_per_candidate: int = 60
    min_training_length: int = 2500
    min_observations: int = 1000
    min_segment_coverage: float = 0.05
    max_insert: int = 700_000
    coverage_exclusion: bool = True
    #: False moves past the insertion as SAM does; True ends such a match one base short.
    short_after_insertion: bool = True

    inclusion_prior: tuple[float, float] | None = None
    start: str = "multinomial"
    fixed_support: bool = False

    def __post_init__(self) -> None:
        if self.start not in ("multinomial", "cover"):
            raise ValueError(f"start: {self.start!r}")
        if self.strand not in ("unstranded", "first", "second"):
            raise ValueError(f"strand: {self.strand!r}")
        if self.output_mode not in ("assembly", "full"):
            raise ValueError(f"output_mode: {self.output_mode!r}")
        if (self.frag_mean is None) != (self.frag_sd is None):
            raise ValueError("frag_mean and frag_sd go together")
        if not 0 <= self.confidence_threshold <= 1:
            raise ValueError("confidence_threshold is between 0 and 1")
