"""Sentiment models: labels, features, training, scoring, versions, evaluation."""
