"""Pure Python over archive bytes, run inside executors; it never imports Spark."""
