"""satchel: a Spark-native library for archives of saved links and text corpora."""
