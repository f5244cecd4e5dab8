"""Arriving strips and running statistics as streams: additions that batch jobs don't need."""
