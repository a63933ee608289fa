"""Thalweg: survey analytics and text retrieval as Spark plans."""
