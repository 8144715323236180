"""Product-catalogue analytics as Spark jobs: validate, gate, link, merge, score, report."""
