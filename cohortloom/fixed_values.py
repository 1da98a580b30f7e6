"""Fixed values.

Results must agree with published ones, so the numbers, names and patterns below are stated as
plain data. Operators take them as arguments; nothing else in the library depends on the domain.
"""

# Quality bounds of one snapshot record (inclusive).
SNAPSHOT_BOUNDS = {
    "genome_size": (4_000_000, 7_500_000),
    "gc": (66.0, 71.0),
    "contigs": (None, 1_000),
    "n50": (20_000, None),
    "checkm_completeness": (90.0, None),
    "checkm_contamination": (None, 5.0),
}
COMPLETENESS_WHEN_BLANK = 0.0
CONTAMINATION_WHEN_BLANK = 100.0

# Points of the additive selection score.
SOURCE_POINTS = {"RefSeq": 100.0}
CATEGORY_POINTS = {"reference genome": 50.0, "representative genome": 35.0}
TYPE_MATERIAL_POINTS = 30.0
LEVEL_POINTS = {"complete genome": 25.0, "chromosome": 20.0, "scaffold": 10.0, "contig": 5.0}
CONTAMINATION_WEIGHT = 2.0
N50_LOG_WEIGHT = 3.0
N50_POINTS_CAP = 20.0
SCORE_DECIMALS = 6

# Accession prefix of the first-choice archive, and the two archive names.
FIRST_ARCHIVE_PREFIX = "GCF_"
ARCHIVE_NAMES = ("RefSeq", "GenBank")

# Name tokens, first match wins.
FINE_LABEL_TOKENS = (
    ("chimaera", "Mycobacterium chimaera legacy subgroup"),
    ("yongonense", "Mycobacterium yongonense legacy subgroup"),
    ("hominissuis", "Mycobacterium avium subsp. hominissuis"),
    ("paratuberculosis", "Mycobacterium avium subsp. paratuberculosis"),
    ("subsp. avium", "Mycobacterium avium subsp. avium"),
    ("silvaticum", "Mycobacterium avium subsp. silvaticum"),
)

# Outcomes of the quality-first selection.
SELECTION_DECISIONS = {
    "qc": "excluded_qc",
    "pair": "excluded_paired_accession_dedup",
    "entity": "excluded_biosample_dedup",
    "selected": "selected_qc_first",
}
SELECTION_REASONS = {"pair": "pair_winner=", "entity": "biosample_winner="}

# Minority-evidence screen.
MIN_DEPTH = 20
MIN_MINOR_COUNT = 5
WIDE_SHARE = (0.10, 0.90)
NARROW_SHARE = (0.20, 0.80)
MIN_MAPPING_QUALITY = 20
MIN_BASE_QUALITY = 20
DEPTH_CAP = 100_000
PROPER_PAIR_BIT = 2
DROP_BITS = 2304

# Thresholds in sites per million callable positions.
CONTROL_MULTIPLIER = 5.0
SWEEP_MULTIPLIERS = (2.0, 3.0, 4.0, 5.0, 7.5, 10.0)
MEMBERSHIP_FLOORS = (98.0, 98.5, 98.6, 99.0)

# Gates of the recovery decision (inclusive).
GATE_BOUNDS = {
    "identity": 99.0,
    "reciprocal_fraction": 0.85,
    "completeness": 90.0,
    "contamination": 5.0,
    "size": (4_000_000, 7_500_000),
    "gc": (66.0, 71.0),
    "contigs": 500,
    "n50": 20_000,
    "type_identity": 94.0,
    "type_fraction": 0.50,
}
RECOVERY_DECISIONS = {
    "same_anchor": "rescued_interpretable",
    "other_anchor": "rescued_interpretable_type_boundary_caution",
    "minor_alleles": "unrecoverable_residual_mac_mixture",
    "route_concordance": "unrecoverable_route_discordance",
    "genome_qc": "unrecoverable_genome_qc",
    "type_anchor": "unrecoverable_type_anchor_instability",
}
RESCUED_PREFIX = "rescued_interpretable"

# Association rules.
DIRECTION_GAP = 0.60
DISCOVERY_FDR = 0.01
DISCOVERY_HIGH, DISCOVERY_LOW = 0.80, 0.20
CONCORDANT_HIGH, CONCORDANT_LOW = 0.75, 0.25
ROUTE_RULES = {"second": (0.60, 0.50), "first": (0.50, 0.40)}
FISHER_TIE_TOLERANCE = 1e-7
ZERO_CELL_SHIFT = 0.5
CI_Z = 1.959963984540054

# Strict-quality inclusion for the sensitivity panel (inclusive).
STRICT_QUALITY = {"completeness": 95.0, "contamination": 2.0, "contigs": 200.0, "n50": 20_000.0}

# Module and edge rules.
MAX_INTERVENING = 5
MIN_PAIR_ENTITIES = 10
MIN_JACCARD = 0.80
MIN_ADJACENCY = 0.80
SYNTENIC_MIN_FEATURES = 3

# Alignment filters.
MIN_ALIGN_IDENTITY = 0.90
FASTA_WIDTH = 80

# Benchmark design.
POOL_SEED = 404
DESIGN_SEED = 202
DESIGN_PAIRS = (
    ("pairA", "Mi1", "Ma20", "calibration_cross_lineage", True),
    ("pairB", "Mi2", "Mi22", "calibration_cross_lineage", False),
    ("pairC", "Mi23", "Mi8", "evaluation_within_mp_mip", False),
    ("pairD", "Mi25", "Mi4", "evaluation_within_mp_mip", True),
)
DESIGN_DEPTHS = (1_000_000, 2_000_000, 4_000_000)
DESIGN_FRACTIONS = (0, 10, 20)
DESIGN_BASE = (10, 2_000_000)
DESIGN_ROLES = {
    "depth": "depth_sensitivity",
    "base_and_depth": "all_pair_10_percent_and_depth_sensitivity",
    "base": "all_pair_10_percent",
}
EXPECTED_RULES = {0: "combined_negative", 10: "auxiliary_or_primary_positive", 20: "primary_positive"}
CONDITION_NAME = "%s__%s_major__%s_minor__p%02d__n%d__s%d"
CONDITION_PATTERN = r"(pair[A-D])__(.+)_major__(.+)_minor__p([0-9]+)__s([0-9]+)"
ALIGNMENT_RATE_PATTERN = r"([0-9.]+)% overall alignment rate"
NESTED_WINDOW_LABEL = "nested-depth-window"

# Tokens a table reader may treat as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Counted letters of one position; the last one holds reference bases outside ACGT.
BASE_NAMES = ("A", "C", "G", "T", "other")

# Analysis-label texts by rule; the rules are in operators/classify.py.
LABEL_COLUMNS = (
    "broad_analysis_panel",
    "provisional_genomic_lineage",
    "figure_label",
    "manuscript_wording",
    "wording_tier",
    "boundary_note",
    "phylogeny_panel",
)
LABEL_TEXTS = {
    "colombiense": (
        "M_colombiense",
        "M_colombiense",
        "M. colombiense",
        "Mycobacterium colombiense",
        "species_supported_public_and_type_anchor",
        "public and type-anchor evidence concordant",
        "colombiense_context",
    ),
    "avium_hominissuis": (
        "M_avium_timonense_boundary",
        "M_avium_hominissuis_adjacent_public_context",
        "M. avium context",
        "Mycobacterium avium public-context group",
        "public_context_supported_anchor_boundary",
        (
            "nearest public genomes are M. avium; hominissuis-adjacent context is descriptive rather than a "
            "strict subspecies assignment, and timonense-anchor proximity is retained because the anchor panel "
            "does not represent all M. avium subspecies diversity"
        ),
        "avium_timonense_context",
    ),
    "avium": (
        "M_avium_timonense_boundary",
        "M_avium_public_group",
        "M. avium context",
        "Mycobacterium avium public-context group",
        "public_context_supported_anchor_boundary",
        (
            "nearest public genomes are M. avium; hominissuis-adjacent context is descriptive rather than a "
            "strict subspecies assignment, and timonense-anchor proximity is retained because the anchor panel "
            "does not represent all M. avium subspecies diversity"
        ),
        "avium_timonense_context",
    ),
    "mp_mip": (
        "M_intracellulare_complex",
        "MI_MP_MIP_lineage",
        "MI: MP-MIP",
        "Mycobacterium intracellulare MP-MIP genomic lineage",
        "lineage_wording_required",
        (
            "M. paraintracellulare/M. indicus pranii-associated genomic group; M. paraintracellulare is retained "
            "only as a historical boundary label"
        ),
        "intracellulare_complex_context",
    ),
    "chimaera": (
        "M_intracellulare_complex",
        "MI_chimaera_adjacent_lineage",
        "MI: chimaera-adjacent",
        "Mycobacterium intracellulare chimaera-adjacent public-context lineage",
        "legacy_subgroup_context_only",
        "public chimaera-adjacent placement with yongonense/typical-MI anchor proximity",
        "intracellulare_complex_context",
    ),
    "yongonense": (
        "M_intracellulare_complex",
        "MI_yongonense_chimaera_boundary",
        "MI: yongonense/chimaera boundary",
        "Mycobacterium intracellulare yongonense/chimaera boundary lineage",
        "legacy_subgroup_boundary_wording_required",
        "fine-anchor margin below 0.15 percentage points",
        "intracellulare_complex_context",
    ),
    "tmi": (
        "M_intracellulare_complex",
        "MI_TMI_lineage",
        "MI: TMI",
        "typical Mycobacterium intracellulare (TMI) genomic lineage",
        "lineage_wording_preferred",
        "typical-MI public/type context; tree confirmation required",
        "intracellulare_complex_context",
    ),
}
LABEL_MARGIN = 0.15
