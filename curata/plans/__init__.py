"""Physical-strategy helpers shared by the operators."""
