"""Spark-first engine for turning books and other long text into cast, reviewed, render-ready line tables."""
