"""The three recommenders: EASE, SLIM and implicit ALS."""
