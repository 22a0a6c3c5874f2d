"""notewise: text-to-outcome analytics expressed as Spark DataFrame jobs.

Notes are cleaned and tokenised with column expressions, matched to a theme
corpus by cosine similarity, clustered, described by topic terms, joined to
visits and outcome intervals, and modelled under participant-level
cross-validation.  Every public operator takes and returns DataFrames.
"""

__version__ = "0.1.0"
