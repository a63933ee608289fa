"""Part of the thalweg survey-analytics engine."""
