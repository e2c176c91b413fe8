"""keytide: timely analytics over keyed event streams, written for Apache Spark."""
