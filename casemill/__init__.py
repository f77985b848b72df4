"""casemill: masking, filling and corpus preparation of clinical case texts on Spark."""
