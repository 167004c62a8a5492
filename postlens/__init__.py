"""Posting analytics on Spark: feeds, matching, scoring, history and shortlists as DataFrame plans."""
