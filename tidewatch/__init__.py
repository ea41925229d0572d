"""tidewatch: customer-churn scoring, explanation and reply analytics as Spark jobs."""
