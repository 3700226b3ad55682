"""Query registries: name -> (spark, sf_dir) -> DataFrame, and the matching oracle SQL."""
