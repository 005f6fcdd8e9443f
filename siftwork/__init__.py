"""siftwork: a PySpark engine that finds and classifies personal data in file stores and text tables."""
