"""quizlode streaming."""
