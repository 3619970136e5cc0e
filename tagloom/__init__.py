"""tagloom: small-RNA, interval and expression analytics as DataFrame-in, DataFrame-out operators on Spark."""
