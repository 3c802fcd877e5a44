"""Exposure analytics on Spark: detectors, scores, rules, history and monitors as DataFrame expressions."""
