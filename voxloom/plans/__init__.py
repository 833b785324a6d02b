"""Result documents that combine several operators."""
