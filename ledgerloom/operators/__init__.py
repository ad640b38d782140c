"""DataFrame operators: ingest, match, judge, reconcile, certify, verify, score."""
