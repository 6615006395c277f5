"""Multi-step jobs: grid search, model comparison, reports."""
