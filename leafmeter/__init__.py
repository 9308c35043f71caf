"""Share-page analytics as Spark jobs: statistics, retention, versions, claims and limits."""
