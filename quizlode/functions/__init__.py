"""quizlode functions."""
