"""tidewell: customer and text analytics as DataFrame-to-DataFrame functions on Spark."""
