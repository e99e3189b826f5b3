"""Rules shared by the registered queries and their SQL."""

from siftline.config import CandidateRules, DecisionRules, FragmentRules, Profile, QcConfig, RunInfo, SamplingPlan

QC = QcConfig()
FRAGMENT = FragmentRules(require_pair_consistency=False)
FRAGMENT_PAIRED = FragmentRules(require_pair_consistency=True)
CANDIDATE = CandidateRules(
    min_nonoverlap_fragments=20,
    min_breadth=0.15,
    theta_pos_absolute=20,
    max_ambiguous_fraction_for_positive=2.8,
    min_positive_evidence_strength="moderate",
)
DECISION = DecisionRules(
    theta_pos=0.003, theta_neg=0.001, theta_neg_fixed=0.0012, negative_cp_lod_max=0.002, noise_floor_fraction=0.0005
)
PLAN = SamplingPlan(seed=20_260_420, rounds=(2_000, 5_000, 10_000))
SINGLE_LOOK = Profile(fragment=FRAGMENT, candidate=CANDIDATE, decision=DECISION)
PROFILE = Profile(qc=QC, fragment=FRAGMENT, candidate=CANDIDATE, decision=DECISION, sampling=PLAN, run=RunInfo())
