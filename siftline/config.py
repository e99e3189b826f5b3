"""Frozen configuration for the operators.

Rules travel as literals inside Column expressions, so Catalyst can fold them;
no operator reads a config file at run time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class QcConfig:
    min_read_length: int = 100
    max_read_length: int = 250
    max_n_fraction: float = 0.10
    min_entropy_bits: float = 1.0
    require_pair: bool = True

    def __post_init__(self) -> None:
        if self.min_read_length <= 0:
            raise ValueError("min_read_length must be positive")
        if self.max_read_length < self.min_read_length:
            raise ValueError("max_read_length must not be below min_read_length")
        if not 0.0 <= self.max_n_fraction <= 1.0:
            raise ValueError("max_n_fraction must lie in [0, 1]")
        if not (math.isfinite(self.min_entropy_bits) and self.min_entropy_bits >= 0.0):
            raise ValueError("min_entropy_bits must be finite and non-negative")


@dataclass(frozen=True)
class FragmentRules:
    min_mapq: int = 20
    min_as_diff: int = 12
    max_nm: int = 8
    require_pair_consistency: bool = True


@dataclass(frozen=True)
class CandidateRules:
    min_nonoverlap_fragments: int = 3
    min_breadth: float = 0.001
    # Carried for profile compatibility; no rule consults it.
    max_background_ratio: float = 1.5
    theta_pos_absolute: int = 1
    max_ambiguous_fraction_for_positive: float = 0.20
    min_positive_evidence_strength: str = "moderate"
    weak_positive_enabled: bool = True


@dataclass(frozen=True)
class DecisionRules:
    theta_pos: float = 5e-5
    theta_neg: float = 5e-6
    theta_neg_fixed: float = 1e-5
    positive_alpha_global: float = 0.05
    positive_statistic_method: str = "exact_binomial_survival_bonferroni"
    negative_cp_lod_max: float = 1e-5
    noise_floor_fraction: float = 1e-6
    allow_indeterminate: bool = True

    @property
    def theta_neg_operational(self) -> float:
        return max(self.theta_neg, self.theta_neg_fixed)

    @property
    def null_probability(self) -> float:
        return max(self.theta_neg_operational, self.noise_floor_fraction)


# Sampling thresholds and default plans.
PROPORTIONAL_MIN_COUNT = 10_000
PROPORTIONAL_MAX_COUNT = 10_000_000
DEFAULT_ROUNDS = (50_000, 100_000, 200_000, 400_000, 800_000)
DEFAULT_PROPORTIONS = (0.002, 0.005, 0.01, 0.02, 0.05, 0.10)
MAX_ROUNDS = 64
DEFAULT_SEED = 20_260_420


@dataclass(frozen=True)
class SamplingPlan:
    """Either absolute round targets or proportions of the QC-passing count."""

    seed: int = DEFAULT_SEED
    mode: str = "representative"
    rounds: tuple[int, ...] = ()
    proportions: tuple[float, ...] = ()
    allow_threshold_override: bool = False
    # How fragments are ranked: ``md5``, which any engine has, or ``siphash13``.
    hash: str = "md5"

    def __post_init__(self) -> None:
        if self.hash not in ("md5", "siphash13"):
            raise ValueError(f"unknown rank hash {self.hash!r}")
        if self.mode not in ("representative", "streaming"):
            raise ValueError(f"unknown sampling mode {self.mode!r}")
        if bool(self.rounds) == bool(self.proportions):
            raise ValueError("give either rounds or proportions")
        if self.mode == "streaming" and self.proportions:
            raise ValueError("streaming looks need absolute rounds")
        steps = self.rounds or self.proportions
        if not 1 <= len(steps) <= MAX_ROUNDS:
            raise ValueError(f"a plan has 1 to {MAX_ROUNDS} rounds")
        if any(not math.isfinite(v) or v <= 0 for v in steps):
            raise ValueError("round values must be finite and positive")
        if self.proportions and max(self.proportions) > 1.0:
            raise ValueError("proportions must not exceed 1")
        if any(b <= a for a, b in zip(steps, steps[1:])):
            raise ValueError("rounds must be strictly increasing")

    @property
    def proportional(self) -> bool:
        return bool(self.proportions)

    @property
    def look_count(self) -> int:
        return len(self.rounds or self.proportions)

    def truncated(self, max_rounds: int) -> "SamplingPlan":
        return replace(self, rounds=self.rounds[:max_rounds], proportions=self.proportions[:max_rounds])

    @classmethod
    def resolve(
        cls,
        *,
        rounds=None,
        proportions=None,
        profile_mode: str | None = None,
        profile_rounds=(),
        profile_proportions=None,
        max_rounds: int = MAX_ROUNDS,
        **kwargs,
    ) -> "SamplingPlan":
        """Explicit rounds, then explicit proportions, then the profile's own settings."""
        if rounds and proportions:
            raise ValueError("rounds and proportions are mutually exclusive overrides")
        if rounds:
            plan = cls(rounds=tuple(rounds), **kwargs)
        elif proportions:
            plan = cls(proportions=parse_proportions(proportions), **kwargs)
        elif profile_mode == "absolute":
            plan = cls(rounds=tuple(profile_rounds), **kwargs)
        elif profile_mode == "proportional":
            plan = cls(proportions=tuple(profile_proportions or DEFAULT_PROPORTIONS), **kwargs)
        elif profile_proportions:
            plan = cls(proportions=tuple(profile_proportions), **kwargs)
        else:
            plan = cls(rounds=tuple(profile_rounds), **kwargs)
        return plan.truncated(max_rounds)


def parse_proportions(values) -> tuple[float, ...]:
    """Accept ``0.25`` and ``"25%"`` alike."""
    parsed = []
    for value in values:
        text = str(value).strip()
        parsed.append(float(text[:-1]) / 100.0 if text.endswith("%") else float(text))
    return tuple(parsed)


@dataclass(frozen=True)
class RunInfo:
    """Constants stamped on every sample of a run."""

    reference_bundle_version: str = "bundle-1"
    calibration_profile_version: str = "profile-1"
    profile_status: str = "release_candidate"
    backend: str = "seed-vote"
    negative_control_required: bool = False
    # Kinds of input that the profile was calibrated for; none given means any.
    supported_input: tuple[str, ...] = ()


@dataclass(frozen=True)
class Profile:
    qc: QcConfig = field(default_factory=QcConfig)
    fragment: FragmentRules = field(default_factory=FragmentRules)
    candidate: CandidateRules = field(default_factory=CandidateRules)
    decision: DecisionRules = field(default_factory=DecisionRules)
    sampling: SamplingPlan = field(default_factory=lambda: SamplingPlan(proportions=DEFAULT_PROPORTIONS))
    run: RunInfo = field(default_factory=RunInfo)

    def problems(self, bundle_version: str | None = None, backend: str | None = None, input_kind: str | None = None) -> list[str]:
        """Why this profile may not judge a run: against the loaded bundle's version, the backend that makes the hits and the kind of input."""
        given = (
            ("reference bundle", self.run.reference_bundle_version, bundle_version),
            ("backend", self.run.backend, backend),
        )
        found = [f"the profile is for {name} `{own}`, not `{other}`" for name, own, other in given if other is not None and own != other]
        if input_kind is not None and self.run.supported_input and input_kind not in self.run.supported_input:
            found.append(f"the profile is for input of {', '.join(self.run.supported_input)}, not `{input_kind}`")
        return found
