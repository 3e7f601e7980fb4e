"""A Spark-native engine for feeds of posts, the schedules read from them, and their text."""
