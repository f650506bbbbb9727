"""repolens: source-code repository analytics and corpus preparation on PySpark."""
