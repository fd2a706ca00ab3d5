"""Policy evaluation, reports, model measures, ratings, screening and cutoff search."""
