"""talentgrid: a Spark-native career-matching analytics engine."""
