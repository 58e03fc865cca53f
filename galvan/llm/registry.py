"""The queries of this subpackage and their SQL."""

from . import (
    centroids,
    decontaminate,
    licenses,
    near_dedup,
    quality_model,
    quality_rules,
    secrets,
    sentencepieces,
    suffix_dedup,
    token_files,
    toxicity,
    whitening,
    wrappers,
)

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_toxicity_fm": toxicity.query,
    "op3_multipart_secrets": secrets.query,
    "op4_cotrained_quality": quality_model.query,
    "op5_simhash_decontamination": decontaminate.query,
    "op6_probminhash_dedup": near_dedup.query,
    "op7_sentencepiece": sentencepieces.query,
    "op8_license_scan": licenses.query,
    "op9_token_files": token_files.query,
    "op10_suffix_dedup": suffix_dedup.query,
    "op11_wrapper_extraction": wrappers.query,
    "op12_centroid_clustering": centroids.query,
    "op13_embedding_whitening": whitening.query,
}
SQL = {"op1_quality_rules": quality_rules.sql(), "op8_license_scan": licenses.sql()}
