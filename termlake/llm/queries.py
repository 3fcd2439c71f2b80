"""The registered query of each operator and the SQL that gives the same rows, where SQL can."""

from . import centroids, divergence, language, mixing, ngrams, packing, pages, quality, shingles, suffixes, token_files, toxicity, vectors

QUERIES = {
    "op1_poisson_mixing": mixing.query,
    "op2_pattern_packing": packing.query,
    "op3_anisotropic_search": vectors.query,
    "op4_consensus_paths": pages.query,
    "op5_elias_fano_ngrams": ngrams.query,
    "op6_rule_cascade": quality.query,
    "op7_plane_token_files": token_files.query,
    "op8_grouped_prefix_join": shingles.query,
    "op9_language_crf": language.query,
    "op10_lexicon_toxicity": toxicity.query,
    "op11_prefix_doubling": suffixes.query,
    "op12_partial_distance_clusters": centroids.query,
    "op13_baseline_divergence": divergence.query,
}
ORACLES = {
    "op1_poisson_mixing": mixing.ORACLE,
    "op6_rule_cascade": quality.ORACLE,
    "op12_partial_distance_clusters": centroids.ORACLE,
    "op13_baseline_divergence": divergence.ORACLE,
}
