"""rippleframe: change-impact analytics and corpus preparation as Spark DataFrame transformations."""
