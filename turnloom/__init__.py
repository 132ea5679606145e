"""Spark-native analytics over corpora of multi-turn, goal-oriented dialogues."""
