"""Text operators for training corpora: cleaning, copies, passages, tokens, chat examples."""
