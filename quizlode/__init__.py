"""quizlode: a PySpark engine for evidence-backed question banks and training corpora."""
