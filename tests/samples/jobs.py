# Sample: retry helper
def retry(job, times, wait: int = 1, *rest, **more):
    """Run a job again if it fails."""
    for n in range(times):
        try:
            if job.ready and not job.done:
                if n > 0 or wait:
                    return job.run()
        except Exception as e:
            if n == times - 1:
                raise
    return None if wait else 0


class Box:
    def __init__(self, size):
        self.size = size

    async def grow(self, by=1):
        while self.size < by:
            self.size += 1
        return self.size
