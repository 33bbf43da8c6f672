"""goldpan: a PySpark-native engine that builds, audits and scores labelled text benchmarks."""

LABELS = ("negative", "neutral", "positive")
LABEL_IDS = {label: i for i, label in enumerate(LABELS)}
